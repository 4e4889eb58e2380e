"""Operators on graphs, vectors and texts."""
