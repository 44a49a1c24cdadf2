"""Scalar functions as Column factories."""
