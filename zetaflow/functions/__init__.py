"""Scalar and array functions as Column factories."""
