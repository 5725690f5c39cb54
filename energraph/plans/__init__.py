"""Registered queries of the reference operators and the SQL that states them again."""
