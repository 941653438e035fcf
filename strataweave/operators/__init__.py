"""Relational operators that any table can use."""
