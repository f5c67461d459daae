"""Versioned, auditable tables on Spark."""
