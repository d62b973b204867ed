"""tabsmith.plans"""
