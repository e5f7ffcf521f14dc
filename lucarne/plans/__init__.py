"""Compositions of operators: reading a table ready for use, and the full column report."""
