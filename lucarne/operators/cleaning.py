"""Header and cell cleaning (CLN-1 to CLN-7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.functions.vocabulary import ERROR_TOKENS, NULL_TOKENS


class TableError(ValueError):
    """The table cannot be used: no columns, no rows, or nothing but nulls."""


def cell(name: str) -> Column:
    """A column reference that takes names with dots, blanks and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_names(names: list[str]) -> list[str]:
    """Byte-order marks and outer blanks removed, empty names filled, repeats numbered (CLN-1)."""
    used: dict[str, int] = {}
    result: list[str] = []
    for raw in names:
        name = raw.replace("﻿", "").strip() or "column"
        repeat = used.get(name, -1) + 1
        used[name] = repeat
        result.append(f"{name}_{repeat}" if repeat else name)
    # A numbered repeat may meet a name that was there already ("a", "a", "a_1").
    taken = set(result)
    if len(taken) < len(result):
        seen: set[str] = set()
        for i, name in enumerate(result):
            while name in seen:
                used[name] = used.get(name, 0) + 1
                candidate = f"{name}_{used[name]}"
                name = candidate if candidate not in taken else name
            seen.add(name)
            taken.add(name)
            result[i] = name
    return result


def clean_column_names(df: DataFrame) -> DataFrame:
    """``df`` under its cleaned names (CLN-1)."""
    return df.toDF(*clean_names(df.columns))


def fill_header(names: list[str]) -> list[str]:
    """Blank or ``Unnamed:`` headings take the last real heading to their left (CLN-2)."""
    last = None
    filled = []
    for name in names:
        if name.strip() and not name.startswith("Unnamed:"):
            last = name
        filled.append(last if last is not None else name)
    return filled


def null_counts(df: DataFrame) -> dict[str, int]:
    """Rows and non-null cells per column in one aggregation: ``{"": rows, column: cells}``."""
    row = df.agg(F.count(F.lit(1)), *[F.count(cell(c)) for c in df.columns]).first()
    return {"": row[0], **{c: row[i + 1] for i, c in enumerate(df.columns)}}


def validate_table(df: DataFrame) -> DataFrame:
    """Return ``df`` unchanged, or raise for no columns, no rows, or only nulls (CLN-3)."""
    if not df.columns:
        raise TableError("the table has no columns")
    # The cheap question first: one row with a value settles it without a full scan.
    if df.filter(reduce(Column.__or__, [cell(c).isNotNull() for c in df.columns])).take(1):
        return df
    if df.take(1):
        raise TableError("every column is entirely null")
    raise TableError("the table has no rows")


def _blank_out(df: DataFrame, tokens: list[str]) -> DataFrame:
    return df.select(*[
        F.when(~cell(f.name).isin(tokens), cell(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else cell(f.name)
        for f in df.schema.fields
    ])


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Cells of text columns that stand for "missing" become null (CLN-4)."""
    return _blank_out(df, NULL_TOKENS)


def error_tokens_to_null(df: DataFrame) -> DataFrame:
    """Spreadsheet error texts become null (CLN-5)."""
    return _blank_out(df, ERROR_TOKENS)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text (CLN-6)."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(cell(f.name)).alias(f.name) if isinstance(f.dataType, nested) else cell(f.name)
        for f in df.schema.fields
    ])


def first_row_looks_like_data(names: list[str]) -> bool:
    """True when no column name holds a letter (CLN-7)."""
    return not any(ch.isalpha() for name in names for ch in name)
