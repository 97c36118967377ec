"""Genetic-variant range queries as Spark DataFrames."""
