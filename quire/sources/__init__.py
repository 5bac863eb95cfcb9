"""Readers: Markdown blocks, document files, the catalog."""
