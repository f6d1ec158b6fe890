"""volclock: Spark-native analytics for candle data on an activity clock."""

__version__ = "0.1.0"
