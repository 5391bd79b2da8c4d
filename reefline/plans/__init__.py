"""Composite analyses (ANA-*) and the registered query catalogue."""
