"""Readers for the file formats that the inputs come in."""
