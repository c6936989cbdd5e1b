"""Operators of the training-data and linkage problems, one module each."""
