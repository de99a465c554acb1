"""Spark jobs for networks of spectral sensors."""
