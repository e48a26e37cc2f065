"""flowlens.plans"""
