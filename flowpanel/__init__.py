"""flowpanel — Spark-native analytics for origin–destination flows and entity × time panels."""

__version__ = "0.1.0"
