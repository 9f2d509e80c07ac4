"""Algorithms on one key's series that no built-in expression has: numpy functions, run by `run.per_key`."""
