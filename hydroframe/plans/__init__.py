"""Whole jobs over many files."""
