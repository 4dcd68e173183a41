"""A Spark-native engine that turns raw, semi-structured postings into structured tables."""
