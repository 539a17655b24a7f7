"""Bibliographic metadata jobs on Spark DataFrames."""
