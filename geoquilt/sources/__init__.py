"""Sources of the point engine."""
