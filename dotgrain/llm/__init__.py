"""Operators for building language-model training corpora (see README)."""
