"""Scans, normalisers, dimension tables and sinks."""
