"""Operators over series (px, ts, value), grids, zones, samples and vectors; all take and return DataFrames."""
