"""Geolith: country-level analytics as Spark jobs."""
