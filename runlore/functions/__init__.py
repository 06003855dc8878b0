"""Column helpers: typed access to dynamic JSON, and text rules."""
