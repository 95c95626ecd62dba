"""Keyed jobs, their records and how they spread."""
