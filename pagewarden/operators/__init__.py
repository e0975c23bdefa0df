"""Relational operators of the audit engine."""
