"""Streaming SQL, sliding windows and online models on PySpark."""
