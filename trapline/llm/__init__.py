"""Operators for large training-data jobs.  Nothing else in the library imports this subpackage."""
