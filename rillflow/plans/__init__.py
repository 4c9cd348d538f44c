"""The statement language."""
