"""wavequill.plans"""
