"""Operators on DataFrames: rows, spans, tables, comparisons."""
