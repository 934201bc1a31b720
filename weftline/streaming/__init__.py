"""Restartable jobs on Structured Streaming; extensions of batch behaviour."""
