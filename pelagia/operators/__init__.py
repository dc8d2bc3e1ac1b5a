"""Relational operators over the catalog; every function maps DataFrames to DataFrames."""
