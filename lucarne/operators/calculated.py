"""Calculated fields and column selection (EXP-1, EXP-9, EXP-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucarne.functions.arithmetic import finite_or_null, is_bad
from lucarne.functions.formula import formula
from lucarne.operators.cleaning import cell


class MathWarning(ValueError):
    """Some rows of a calculated field are NaN or infinite."""

    def __init__(self, affected_rows: int, total_rows: int):
        super().__init__(f"{affected_rows} of {total_rows} rows would be NaN or infinite")
        self.affected_rows, self.total_rows = affected_rows, total_rows


def math_check(df: DataFrame, expression: str | Column) -> DataFrame:
    """Rows, nulls, NaNs and infinities a formula would give (EXP-9)."""
    x = formula(expression, df.columns) if isinstance(expression, str) else expression
    return df.select(x.cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("x").isNull()).alias("null_rows"),
        F.count_if(F.isnan("x")).alias("nan_rows"),
        F.count_if(F.abs("x") == float("inf")).alias("inf_rows"),
        F.count_if(is_bad(F.col("x"))).alias("affected_rows"),
    )


def add_field(df: DataFrame, name: str, expression: str | Column, force: bool = False) -> DataFrame:
    """Append a column computed by a formula (EXP-1).

    Without ``force`` the formula is checked first and refused if any row is NaN or infinite;
    with it, those cells become null and no extra pass is made.
    """
    name = name.strip()
    if not name:
        raise ValueError("a calculated field needs a name")
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    value = formula(expression, df.columns) if isinstance(expression, str) else expression
    if force:
        return df.withColumn(name, finite_or_null(value))
    check = math_check(df, value).first()
    if check["affected_rows"]:
        raise MathWarning(check["affected_rows"], check["total_rows"])
    return df.withColumn(name, value)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the order named (EXP-11)."""
    return df.select(*[cell(c) for c in columns if c in df.columns])
