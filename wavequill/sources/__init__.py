"""wavequill.sources"""
