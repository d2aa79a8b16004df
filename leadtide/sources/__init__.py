"""Readers and writers, and the adapters that give the tables their roles."""
