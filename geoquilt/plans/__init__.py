"""Plans of the point engine."""
