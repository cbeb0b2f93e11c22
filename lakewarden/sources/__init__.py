"""lakewarden sources"""
