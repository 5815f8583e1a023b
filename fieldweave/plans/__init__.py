"""fieldweave.plans"""
