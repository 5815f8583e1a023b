"""fieldweave.sources"""
