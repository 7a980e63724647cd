"""Operators on training text and model answers."""
