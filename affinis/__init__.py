"""Batch and streaming recommendation jobs on PySpark DataFrames."""
