"""Lattica: dependency-graph analytics and corpus processing on PySpark DataFrames."""
