"""Readers of text forms."""
