"""fieldweave.functions"""
