"""Gridded time-series analytics on PySpark."""
