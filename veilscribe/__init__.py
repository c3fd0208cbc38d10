"""Spark-native analytics over multilingual speech transcripts."""
