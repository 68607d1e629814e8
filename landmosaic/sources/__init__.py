"""Readers of files that Spark has no format for, and writers of tables."""
