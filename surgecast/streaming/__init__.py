"""Incremental versions of the scheduled steps."""
