"""eddyflow: a Spark-native analytics engine for event-time SQL."""

__version__ = "0.1.0"
