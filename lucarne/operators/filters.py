"""Filters, search, sort and paging (FLT-1 to FLT-11)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.functions.casts import shown
from lucarne.functions.vocabulary import DISTINCT_LIMIT, FILTER_TRUE, PREVIEW_ROWS
from lucarne.operators.cleaning import cell


def apply_filters(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Equality for a single value, membership for a list, all ANDed (FLT-1, FLT-2).

    Unknown columns and empty lists are ignored. Boolean columns take their usual spellings.
    """
    for name, wanted in (filters or {}).items():
        if name not in df.columns:
            continue
        many = isinstance(wanted, (list, tuple, set, frozenset))
        values = list(wanted) if many else [wanted]
        if not values:
            continue
        kind = df.schema[name].dataType
        literals = [_as_type(v, kind) for v in values]
        df = df.filter(cell(name).isin(literals) if many else cell(name) == literals[0])
    return df


def _as_type(value: Any, kind: T.DataType) -> Column:
    """The wanted value in the column's own type, so that the test reaches the file reader.

    Text that is no such value matches nothing instead of failing the query.
    """
    if isinstance(kind, T.BooleanType):
        return F.lit(str(value).lower() in FILTER_TRUE)
    if isinstance(kind, T.StringType):
        return F.lit(value if value is None else str(value))
    return F.lit(value).try_cast(kind) if isinstance(value, str) else F.lit(value)


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have a value in every one of ``columns`` (FLT-3)."""
    return df.dropna(subset=[f"`{c}`" if "." in c else c for c in columns])


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains ``text``, ignoring case (FLT-4)."""
    if not text:
        return df
    needle = F.lit(text.lower())
    hits = [F.coalesce(F.contains(F.lower(shown(cell(c), t)), needle), F.lit(False)) for c, t in df.dtypes]
    return df.filter(reduce(Column.__or__, hits))


def distinct_values(df: DataFrame, column: str, limit: int = DISTINCT_LIMIT, search: str | None = None) -> DataFrame:
    """The first ``limit`` distinct values in order; NaN and infinities read as null (FLT-5).

    With ``search`` only values whose text contains it, ignoring case, are listed; the limit comes after the search (FLT-6).
    """
    value = cell(column).alias("value")
    found = df.select(value).filter(F.col("value").isNotNull()).distinct()
    if search is not None:
        found = search_values(found, search)
    listed = found.orderBy("value").limit(limit)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        bad = F.isnan("value") | (F.abs("value") == float("inf"))
        listed = listed.select(F.when(~bad, F.col("value")).alias("value"))
    return listed


def distinct_total(df: DataFrame, column: str) -> DataFrame:
    """How many distinct values there are, null counted as one (FLT-5); close whole numbers are counted by bitmaps."""
    from lucarne.operators.profile import distinct_counts

    null = 0 if df.filter(cell(column).isNull()).isEmpty() else 1
    return distinct_counts(df, [column]).agg((F.coalesce(F.sum("uniques"), F.lit(0)) + null).alias("total_unique"))


def search_values(values: DataFrame, text: str, column: str = "value") -> DataFrame:
    """Values whose text contains ``text``, ignoring case (FLT-6); to search a column use ``distinct_values(search=)``."""
    return values.filter(F.contains(F.lower(shown(cell(column), dict(values.dtypes)[column])), F.lit(text.lower())))


def ordering(by: Sequence[str | tuple[str, bool]], key: Sequence[str] = ()) -> list[Column]:
    """Sort terms: names or ``(name, ascending)``, nulls first ascending, then the key columns."""
    pairs = [(b, True) if isinstance(b, str) else b for b in by]
    terms = [cell(n).asc_nulls_first() if up else cell(n).desc_nulls_last() for n, up in pairs]
    return terms + [cell(k).asc_nulls_first() for k in key if k not in {n for n, _ in pairs}]


def sort_rows(df: DataFrame, by: Sequence[str | tuple[str, bool]], key: Sequence[str] = ()) -> DataFrame:
    """Sort by columns (FLT-7).

    Name the ``key``: it settles ties and, being part of the range boundaries, lets Spark cut a
    value that holds a third of the rows into many ranges.
    """
    return df.orderBy(*ordering(by, key))


def page(
    df: DataFrame, by: Sequence[str | tuple[str, bool]], key: Sequence[str], number: int, size: int = 15
) -> DataFrame:
    """Page ``number`` (from 0) of the sorted rows (FLT-8). For deep pages use ``page_after`` or ``pages.SortedPages``."""
    return df.orderBy(*ordering(by, key)).offset(number * size).limit(size)


def page_after(df: DataFrame, key: str, last: Any, size: int = 15) -> DataFrame:
    """The ``size`` rows that follow key ``last``: a pushed-down filter instead of an offset (FLT-8)."""
    rows = df if last is None else df.filter(cell(key) > F.lit(last))
    return rows.orderBy(cell(key)).limit(size)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, key: Sequence[str] = ()) -> DataFrame:
    """The first rows, every column as text (FLT-9); in key order where a key is named."""
    head = (df.orderBy(*[cell(k) for k in key]) if key else df).limit(rows)
    return head.select(*[shown(cell(c), t).alias(c) for c, t in df.dtypes])


def anomaly_rows_only(df: DataFrame, anomalies: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is among the anomalies (FLT-10)."""
    return df.join(anomalies.select(*key), list(key), "left_semi")


def by_severity(anomalies: DataFrame, severity: str | None) -> DataFrame:
    """One severity, or all of them for None (FLT-11)."""
    return anomalies if severity is None else anomalies.filter(F.col("severity") == severity)
