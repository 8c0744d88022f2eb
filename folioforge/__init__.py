"""Folioforge: document-library analytics expressed as Spark DataFrame plans."""
