"""tabsmith.sources"""
