"""Sources: trees of source and configuration files as tables."""
