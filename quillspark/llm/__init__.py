"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Every module holds one operator with a
general interface; `queries` registers one query per operator over the standard tables.
"""
