"""Relational building blocks: joins, indicator scans, tagging."""
