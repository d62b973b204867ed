"""tabsmith.streaming"""
