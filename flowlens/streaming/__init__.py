"""flowlens.streaming"""
