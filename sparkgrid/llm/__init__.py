"""Operators that prepare text tables for language-model training."""
