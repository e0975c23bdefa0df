"""Readers and parsers that give the audit tables."""
