"""Readers of dictionary sources."""
