"""fieldweave.streaming"""
