"""Relational operators over records and vectors."""
