"""Soft-membership tree analytics written with Spark DataFrames."""
