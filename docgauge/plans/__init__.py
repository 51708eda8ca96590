"""Whole evaluations put together from operators."""
