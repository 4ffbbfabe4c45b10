"""Readers of account statements."""
