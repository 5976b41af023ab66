"""Ridgeline plans."""
