"""Registered queries with their independent SQL, grouped by area."""
