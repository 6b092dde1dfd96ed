"""Incremental forms of the tallies."""
