"""Relational operators over cell tables."""
