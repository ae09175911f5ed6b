"""Readers, landed files and snapshots."""
