"""Operators over the long feature x sample table."""
