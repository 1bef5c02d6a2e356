"""Checks and analyses geotagged field reports with Spark."""
