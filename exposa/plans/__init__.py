"""Staged plans and the query catalogue."""
