"""Readers and table projections."""
