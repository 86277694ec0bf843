"""Queries over the stored tables."""
