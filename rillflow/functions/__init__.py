"""Window aggregates and user-defined functions."""
