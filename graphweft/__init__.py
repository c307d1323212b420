"""graphweft: Spark-native analytics for large labelled, multi-relational, time-stamped graphs."""

__version__ = "0.1.0"
