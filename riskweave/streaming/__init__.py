"""riskweave.streaming"""
