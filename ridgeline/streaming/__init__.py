"""Ridgeline streaming."""
