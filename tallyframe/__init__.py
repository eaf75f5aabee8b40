"""tallyframe: Spark-native analytics for text-scoring studies."""

__version__ = "0.1.0"
