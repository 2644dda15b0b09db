"""Distributed operators over statement tables."""
