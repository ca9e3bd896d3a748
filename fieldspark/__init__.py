"""A Spark-native engine for time-stepped simulation results and conversational corpora."""
