"""Continuous preparation of arriving rows."""
