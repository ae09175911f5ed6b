"""Streaming forms of the table operators, for data that keeps arriving."""
