"""Whole pipelines and the query catalog."""
