"""Queries over the tables, each with the SQL that states the same result."""
