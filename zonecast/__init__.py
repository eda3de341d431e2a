"""Geo-temporal hotspot, forecast and deployment analytics as Spark jobs."""
