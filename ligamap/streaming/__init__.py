"""Operators over arriving requests."""
