"""bibliome: a Spark-native engine for building and querying a corpus of scientific literature."""

__version__ = "0.1.0"
