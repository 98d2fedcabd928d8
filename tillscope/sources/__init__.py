"""Readers for the retail tables."""
