"""tabsmith.functions"""
