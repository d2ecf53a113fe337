"""Relational operators on the match, delivery and feature tables."""
