"""Scalar functions as column expressions, and numerical routines on arrays."""
