"""Relational co-occurrence analytics on DataFrames."""
