"""Scalar functions on columns and on numpy arrays."""
