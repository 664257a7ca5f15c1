"""Readers and writers of the tables on disk."""
