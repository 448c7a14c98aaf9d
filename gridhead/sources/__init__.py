"""Workbook files in, result records out."""
