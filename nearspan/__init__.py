"""Neighbor search and data preparation on Spark DataFrames."""
