"""flowlens.sinks"""
