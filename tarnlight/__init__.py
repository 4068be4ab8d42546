"""Tarnlight: web-readiness analytics and data preparation as lazy Spark plans."""

__version__ = "0.1.0"
