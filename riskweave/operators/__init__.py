"""riskweave.operators"""
