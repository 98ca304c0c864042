"""Queries as a user runs them: page-level compositions and the named query list."""
