"""Column functions: digests and compatibility helpers."""
