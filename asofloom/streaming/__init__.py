"""Matrices of as-of dates as a stream of events passes them."""

from .matrices import matrix_stream

__all__ = ["matrix_stream"]
