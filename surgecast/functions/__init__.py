"""Column expressions (no actions, no session)."""
