"""Streaming of the point engine."""
