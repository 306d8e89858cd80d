"""Queries over the test tables, each with the SQL that it is checked against."""
