"""wavequill.functions"""
