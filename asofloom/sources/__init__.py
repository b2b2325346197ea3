"""Configurations and tables."""
