"""Schemas, readers and writers for evaluation data."""
