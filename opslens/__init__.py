"""Operational analytics on Spark that keeps sensitive columns out."""
