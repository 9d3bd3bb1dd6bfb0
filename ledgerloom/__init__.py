"""A PySpark-native engine for linking noisy records across sources."""
