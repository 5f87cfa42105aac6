"""Relational operators: table algebra, profiling, query templates, guarded SQL and scoring."""
