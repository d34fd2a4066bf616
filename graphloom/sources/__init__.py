"""Part of graphloom: sources."""
