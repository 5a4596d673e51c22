"""citelens.sources"""
