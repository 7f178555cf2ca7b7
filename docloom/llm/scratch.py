"""Intermediate tables in the folder that driver and executors share."""

from docloom.sources.shared import drop, shared_dir, table

__all__ = ["drop", "shared_dir", "table"]
