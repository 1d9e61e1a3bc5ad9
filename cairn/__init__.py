"""cairn: a PySpark-native engine for analysing and safely sharing a corpus of files."""

__version__ = "0.1.0"
