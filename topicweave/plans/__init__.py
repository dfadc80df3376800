"""Helpers that decide where intermediate results live, and whole jobs."""
