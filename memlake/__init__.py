"""memlake: a Spark-native memory and retrieval analytics engine."""

__version__ = "0.1.0"
