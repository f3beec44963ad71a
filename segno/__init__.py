"""segno: a Spark-native analytics engine for symbolic-music corpora."""

__version__ = "0.1.0"
