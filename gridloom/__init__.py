"""Annotated observation-by-feature data on Spark."""
