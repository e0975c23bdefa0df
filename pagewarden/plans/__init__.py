"""Queries: whole audits and their parts."""
