"""Geospatial detection analytics as Spark DataFrame jobs."""
