"""wavequill.operators"""
