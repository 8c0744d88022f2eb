"""Folioforge streaming."""
