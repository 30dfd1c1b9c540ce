"""Reading and writing tables, snapshots and models."""
