"""Operators over tables and posting tables."""
