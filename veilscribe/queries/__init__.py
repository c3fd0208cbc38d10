"""Queries over the star-schema and document tables, one or more for each operator, with SQL that gives the same rows."""
