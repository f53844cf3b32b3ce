"""Micro-batch input."""
