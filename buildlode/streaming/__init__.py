"""Structured Streaming jobs over staged data."""
