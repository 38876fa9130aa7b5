"""Compositions of operators: result tables, the health analysis, the parameter search."""
