"""Lint rules over the parsed tables."""
