"""Structured Streaming versions of the stage flow and its metrics."""
