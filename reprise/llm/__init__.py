"""Operators for building training data from large text tables. Nothing outside this package imports it."""
