"""Operators for building training corpora, with one registered query each."""
