"""Incremental refresh of the reporting job."""
