"""Scoring results as they arrive."""
