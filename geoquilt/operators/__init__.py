"""Operators of the point engine."""
