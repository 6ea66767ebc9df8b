"""Spark-native motion-similarity analytics: DataFrame in, DataFrame out."""
