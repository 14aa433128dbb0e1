"""Operators for training-data pipelines over the text tables. Nothing else in the library imports this subpackage."""
