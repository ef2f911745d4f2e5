"""Queries over the driver's tables, with the SQL that they are checked against."""
