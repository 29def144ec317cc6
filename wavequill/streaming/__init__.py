"""wavequill.streaming"""
