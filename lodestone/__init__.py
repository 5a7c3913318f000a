"""A PySpark-native engine for corpus ingestion and hybrid retrieval."""

__version__ = "0.2.0"
