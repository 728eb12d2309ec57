"""Relational operators of the entropy kernel. All take and return DataFrames."""
