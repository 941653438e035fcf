"""Incremental runs over a stream of file changes."""
