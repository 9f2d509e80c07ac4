"""Scalar functions with no-data rules, and the calendar."""
