"""Registered queries, each with an SQL oracle where SQL can express it."""
