"""Declared entities, and where their rows come from."""
