"""Operators for building training data from a large text corpus."""
