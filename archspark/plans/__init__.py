"""Queries, adapters and end-to-end plans."""
