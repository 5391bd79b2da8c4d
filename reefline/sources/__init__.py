"""Scans, literal dimensions, grids and bindings of the driver tables."""
