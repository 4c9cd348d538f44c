"""Relational building blocks: windows, features, models."""
