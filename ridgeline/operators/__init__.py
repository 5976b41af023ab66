"""Ridgeline operators."""
