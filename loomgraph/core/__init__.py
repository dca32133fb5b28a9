"""Shared building blocks: session settings, loops, skew-safe joins, global order."""
