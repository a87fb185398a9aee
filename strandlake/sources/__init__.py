"""Readers of call files, annotations and key tables."""
