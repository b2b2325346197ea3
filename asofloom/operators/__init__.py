"""Operators that compose several DataFrame operations."""
