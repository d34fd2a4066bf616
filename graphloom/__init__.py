"""Spark jobs that index source code as a property graph and search it."""
