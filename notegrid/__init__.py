"""Spark jobs over large corpora of linked notes."""
