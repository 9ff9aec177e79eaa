"""Declared stores: operations checked once, bound at each call; schemas and hooks."""
