"""Queries, their SQL and what they share."""
