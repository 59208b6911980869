"""Vocabulary memory over text, on Spark: see README.md."""
