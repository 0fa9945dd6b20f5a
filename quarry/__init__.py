"""quarry: a PySpark-native document retrieval and corpus analytics engine."""

__version__ = "0.1.0"
