"""Registered queries: each runs an operator over whole given tables, with its SQL twin."""
