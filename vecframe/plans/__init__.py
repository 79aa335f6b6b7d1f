"""Planner and query language."""
