"""shoplight: clickstream and commerce analytics for an online game shop, as Spark jobs.

Operators are plain functions from DataFrames to a DataFrame. They build a logical
plan only; nothing runs until the caller writes or collects the result.
"""
