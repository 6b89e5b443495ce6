"""Causal analytics, retrieval and corpus preparation expressed in Spark DataFrames."""
