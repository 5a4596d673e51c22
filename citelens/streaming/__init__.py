"""citelens.streaming"""
