"""Part of graphloom: operators."""
