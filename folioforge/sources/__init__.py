"""Folioforge sources."""
