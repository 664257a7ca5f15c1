"""Registered queries over the test tables, each with SQL that says the same."""
