"""Column-level building blocks: fixed values, casts, float arithmetic, formulas."""
