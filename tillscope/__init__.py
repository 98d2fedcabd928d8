"""Retail-commerce analytics as lazy Spark DataFrame functions."""
