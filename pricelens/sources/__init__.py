"""Readers of what is no table."""
