"""lakewarden streaming"""
