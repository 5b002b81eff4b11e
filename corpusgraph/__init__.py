"""Spark-native analytics over document collections and their entity graphs.

Every operator takes DataFrames and returns a lazy DataFrame; expressions in
``functions`` return Columns.  Nothing reads the clock: callers pass ``as_of``.
"""
