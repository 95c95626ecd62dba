"""Placement plans and their benchmark."""
