"""Readers and writers of the file formats, and adapters of relational tables."""
