"""A Spark-native engine for cohorts, event series and synthetic-data evaluation."""
