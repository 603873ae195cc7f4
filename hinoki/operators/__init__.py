"""Lattice, tokenization and their relational forms."""
