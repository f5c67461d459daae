"""The change feed as a stream, and windows over events."""
