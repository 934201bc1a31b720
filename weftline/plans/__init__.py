"""Execution helpers shared by operators: scratch tables, sessions, readers."""
