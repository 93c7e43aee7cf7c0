"""A PySpark-native engine for monitoring time series: statistics, detectors, gates, incidents and their evaluation."""
