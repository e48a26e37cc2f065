"""flowlens.functions"""
