"""Registered queries: each runs an operator over whole tables, most with a SQL twin."""
