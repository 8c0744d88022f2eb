"""Folioforge functions."""
