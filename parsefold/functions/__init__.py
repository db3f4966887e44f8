"""Scalar functions on text columns."""
