"""Readers and writers of statements, tables, predictions and reports."""
