"""lakewarden operators"""
