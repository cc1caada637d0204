"""Registered queries: an operator applied to the given tables, with its check in SQL."""
