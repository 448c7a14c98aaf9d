"""Spark jobs that find the header row in large collections of spreadsheet-like grids."""
