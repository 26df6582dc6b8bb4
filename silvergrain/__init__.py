"""Catalog analytics for media and document collections, written for Spark."""
