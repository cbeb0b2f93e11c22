"""lakewarden plans"""
