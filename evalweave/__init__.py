"""evalweave: a PySpark-native engine for evaluating retrieval-augmented multi-label text classification."""

__version__ = "0.1.0"
