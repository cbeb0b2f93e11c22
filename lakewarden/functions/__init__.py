"""lakewarden functions"""
