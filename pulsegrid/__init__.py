"""Distributed analytics for large collections of sensor series, on Spark DataFrames.

A *series* is a long table ``(tag STRING, ts TIMESTAMP_NTZ, value DOUBLE)`` with at most one
reading per tag and timestamp.  Every operator works on all tags at once.
"""
