"""Bag/instance analytics on Spark: DataFrame in, DataFrame out."""
