"""Operators that prepare language-model training data."""
