"""fieldweave.operators"""
