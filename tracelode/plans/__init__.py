"""The queries over the tables, and SQL functions."""
