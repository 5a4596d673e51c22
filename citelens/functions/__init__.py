"""citelens.functions"""
