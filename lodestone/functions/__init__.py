"""Scalar functions as Column expressions, and vectorised UDFs where none exist."""
