"""Registered queries: each operator over the given tables, with the SQL that must agree with it."""
