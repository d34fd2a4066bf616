"""Part of graphloom: jobs."""
