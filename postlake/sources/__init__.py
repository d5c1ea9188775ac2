"""Readers of mail containers."""
