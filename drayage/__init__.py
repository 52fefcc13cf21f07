"""A PySpark-native engine for semi-structured freight documents and corpora."""
