"""Column functions over coding sequences."""
