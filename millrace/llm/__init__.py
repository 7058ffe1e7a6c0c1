"""Operators for large training-data pipelines; nothing else in millrace imports this package."""
