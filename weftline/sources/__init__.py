"""Readers and writers for source folders, listings, checkpoints and reports."""
