"""Duplicate and reuse detection as DataFrame operations."""
