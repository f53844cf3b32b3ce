"""Queries and the block codec."""
