"""Functions of the point engine."""
