"""citelens: a PySpark-native engine for studying which pages get cited in generated search answers."""

__version__ = "0.1.0"
