"""Operators that prepare language-model training data; nothing outside this package imports it."""
