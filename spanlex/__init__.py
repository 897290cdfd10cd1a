"""spanlex: a PySpark-native ranked-retrieval and corpus-processing engine."""

__version__ = "0.1.0"
