"""Transformations of grids and rows."""
