"""Relational and vector operators on DataFrames."""
