"""Running pipelines over live sources."""
