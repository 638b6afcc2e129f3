"""Queries over the given tables, and the SQL that answers the same."""
