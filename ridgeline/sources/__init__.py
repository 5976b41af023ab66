"""Ridgeline sources."""
