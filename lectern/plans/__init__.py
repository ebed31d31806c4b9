"""Whole queries over a folder of tables, each with the SQL that says the same (where SQL can)."""
