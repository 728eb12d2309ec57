"""Continuous forms of the kernel's counts."""
