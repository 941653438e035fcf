"""Training-data operators: ten corpus-preparation steps for very large text tables."""
