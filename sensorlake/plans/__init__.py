"""Registered queries and end-to-end jobs."""
