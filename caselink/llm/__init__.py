"""Operators of a training-data pipeline over text corpora. Nothing else in the library imports this package."""
