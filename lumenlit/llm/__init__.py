"""Operators for preparing text and vectors as model training data. Nothing else in the package imports this."""
