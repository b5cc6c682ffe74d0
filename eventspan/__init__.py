"""eventspan: a PySpark-native engine for time-series event analytics."""
