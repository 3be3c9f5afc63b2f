"""hashmark: a PySpark-native engine for keyed, ordered event tables (play-by-play being the motivating domain)."""
