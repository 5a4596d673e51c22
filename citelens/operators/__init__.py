"""citelens.operators"""
