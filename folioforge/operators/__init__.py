"""Folioforge operators."""
