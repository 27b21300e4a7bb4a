"""Operators on training text and vectors, one module each; ``queries`` registers them."""
