"""Part of graphloom: functions."""
