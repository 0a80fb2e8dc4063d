"""Composed chains and the registry of runnable queries."""
