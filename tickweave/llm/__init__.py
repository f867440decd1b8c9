"""Operators for building training data from text, pages and vectors."""
