"""Operators for cleaning and packing training text."""
