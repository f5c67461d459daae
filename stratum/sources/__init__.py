"""Storage of tables, log and snapshots."""
