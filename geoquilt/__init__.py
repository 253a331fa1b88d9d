"""Spark-first analytics over labelled 2-D points."""
