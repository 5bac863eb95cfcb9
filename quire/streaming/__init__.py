"""Document files as streams."""
