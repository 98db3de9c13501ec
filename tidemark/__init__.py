"""Ordered-event analytics on PySpark DataFrames."""
