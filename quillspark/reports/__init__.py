"""Renderers over collected results: one row per file, so they run on the driver."""
