"""Operators for training-data pipelines.  Nothing else in skyloom imports this subpackage."""
