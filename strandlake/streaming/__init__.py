"""Keeping a store's tables up to date with call files that arrive."""
