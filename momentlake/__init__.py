"""Moments, ideas, graphs and retrieval over timestamped text, as Spark DataFrames."""
