"""Readers of cohorts, volumes, sidecars and tables."""
