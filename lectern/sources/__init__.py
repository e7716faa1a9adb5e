"""Readers of tables, source databases and recording folders."""
