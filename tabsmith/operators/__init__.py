"""tabsmith.operators"""
