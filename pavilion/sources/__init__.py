"""Readers and writers: match documents, the two base tables, feature tables."""
