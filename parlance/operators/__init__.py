"""Relational operators over turns, lines, windows and result rows."""
