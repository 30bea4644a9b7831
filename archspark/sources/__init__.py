"""Readers and writers: syntax snapshots, source trees, extractors."""
