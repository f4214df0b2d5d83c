"""The operators bound to the given tables, each with an equivalent query in SQL."""
