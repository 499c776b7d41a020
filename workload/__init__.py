"""Queries over the given test tables and their SQL counterparts."""
