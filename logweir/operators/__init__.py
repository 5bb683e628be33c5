"""Relational operators over log records and tables."""
