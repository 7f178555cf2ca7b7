"""Registered queries over the stand-in views and the SQL that states the same."""
