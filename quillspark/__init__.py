"""A PySpark engine that measures disorder in versioned text and source code."""
