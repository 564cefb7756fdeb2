"""Tessel: an analytics engine on Spark's own DataFrame and SQL planner."""
