"""flowlens.operators"""
