"""Millrace: an analytics engine expressed in PySpark DataFrames and SQL."""
