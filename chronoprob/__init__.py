"""Probability-trace analytics on Spark: DataFrame-in, DataFrame-out operators."""
