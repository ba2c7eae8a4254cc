"""Compressed data at scale on Spark."""
