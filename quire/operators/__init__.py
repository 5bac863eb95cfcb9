"""Operators on documents: extraction, rendering, sections, search, tags, links, integrity, changes."""
