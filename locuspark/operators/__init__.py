"""Operators on DataFrames: filters, regions, tallies, alignment of samples, statistics."""
