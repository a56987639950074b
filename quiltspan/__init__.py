"""Interval-annotated architectures, compared with Spark DataFrames."""
