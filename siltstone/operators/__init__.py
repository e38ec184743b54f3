"""Relational operators over the knowledge-base tables."""
