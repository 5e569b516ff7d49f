"""Prepare, execute, score and report on text-to-SQL data with Spark DataFrames."""
