"""Group summaries and cross-tabs with a totals row (PVT-1 to PVT-9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucarne.functions.arithmetic import finite_or_null, round_exact
from lucarne.functions.casts import is_numeric_type
from lucarne.functions.vocabulary import PIVOT_SEPARATOR, PIVOT_WIDTH
from lucarne.operators.cleaning import cell
from lucarne.operators.filters import apply_filters

AGGREGATES = ("sum", "mean", "count", "min", "max")


def _value_specs(values, value_col, agg_func) -> list[tuple[str, str]]:
    """``[(column, aggregate)]`` from pairs, mappings or the older single-value arguments (PVT-9)."""
    if not values and value_col:
        values = [(value_col, agg_func or "sum")]
    pairs = [(v["col"], v.get("agg", "sum")) if isinstance(v, Mapping) else tuple(v) for v in values or []]
    return [(c, a if a in AGGREGATES else "sum") for c, a in pairs]


def _check(df: DataFrame, rows: Sequence[str], columns: Sequence[str], specs: list[tuple[str, str]]) -> None:
    """Refuse what the report builder refuses, before any plan is made (PVT-8)."""
    if not rows or not specs:
        raise ValueError("a pivot needs at least one row column and one value")
    types = dict(df.dtypes)
    placed: set[str] = set()
    for name in [*rows, *columns, *[c for c, _ in specs]]:
        if name not in types:
            raise ValueError(f"unknown column {name!r}")
        if name in placed:
            raise ValueError(f"column {name!r} is used more than once")
        placed.add(name)
    for name, agg in specs:
        if agg != "count" and not is_numeric_type(types[name]):
            raise ValueError(f"column {name!r} is not numeric: only count applies")


def _aggregate(column: str, agg: str) -> Column:
    """One aggregate over the column as double; count counts rows (PVT-2)."""
    if agg == "count":
        return F.count(F.lit(1))
    number = cell(column).try_cast("double")
    if agg == "sum":
        return F.coalesce(F.sum(number), F.lit(0.0))
    return {"mean": F.avg, "min": F.min, "max": F.max}[agg](number)


def _pivot_key(columns: Sequence[str]) -> Column:
    """Text of the pivot cells behind a "v"; several columns are joined, any null makes the key "n" (PVT-4)."""
    parts: list[Column] = [F.lit("v")]
    for c in columns:
        parts += [F.lit(PIVOT_SEPARATOR), cell(c).cast("string")]
    return F.coalesce(F.concat(parts[0], *parts[2:]), F.lit("n"))


def _shown_keys(keys: Sequence[str]) -> dict[str, str]:
    """What each key is called: its text, "null" for null, and "null (text)" for that very text beside a null."""
    shown = {k: k[1:] if k != "n" else "null" for k in keys}
    if "n" in shown and "vnull" in shown:
        shown["vnull"] = "null (text)"
    return shown


def pivot(
    df: DataFrame,
    rows: Sequence[str],
    values: Sequence[Any] = (),
    columns: Sequence[str] = (),
    filters: Mapping[str, Any] | None = None,
    totals: str | None = "displayed",
    value_col: str | None = None,
    agg_func: str | None = None,
    max_columns: int = PIVOT_WIDTH,
) -> DataFrame:
    """Aggregates per row group, spread over the values of ``columns`` if any are named.

    ``totals="displayed"`` adds a row flagged ``is_total`` that sums the shown cells of every value
    column, whatever its aggregate (PVT-6); ``"recompute"`` applies the aggregate to the whole
    table instead; None leaves the row out. Cells are rounded to two decimals (PVT-7). More than ``max_columns`` values
    of ``columns`` are refused, and so is a row column named ``is_total``.
    """
    if "is_total" in rows:
        raise ValueError("a row column cannot be called is_total")
    specs = _value_specs(values, value_col, agg_func)
    _check(df, rows, columns, specs)
    df = apply_filters(df, filters)
    named = len(specs) > 1 or bool(columns)
    aggregates = [_aggregate(c, a).alias(f"{a}({c})" if named else c) for c, a in specs]
    types = {f"{a}({c})" if named else c: a for c, a in specs}

    if columns:
        own = "pivot_key"
        while own in df.columns:
            own += "_"
        keyed = df.withColumn(own, _pivot_key(columns))
        found = keyed.select(own).distinct().limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"too many pivot columns (more than {max_columns})")
        called = _shown_keys([r[0] for r in found])
        keys = sorted(called.values())
        inner = sorted(called, key=called.get)

        def spread(data: DataFrame, by: Sequence[str]) -> DataFrame:
            wide = data.groupBy(*[cell(r) for r in by]).pivot(own, inner).agg(*aggregates)
            # Spark names a cell by its key (one aggregate) or key_aggregate (several).
            if len(specs) > 1:
                shown = [cell(f"{k}_{n}").alias(f"{n}_{called[k]}") for n in types for k in inner]
            else:
                shown = [cell(k).alias(called[k]) for k in inner]
            return wide.select(*[cell(r) for r in by], *shown)

        table = spread(keyed, rows)
        headers = {f"{n}_{k}" if len(specs) > 1 else k: a for n, a in types.items() for k in keys}
    else:
        keyed = df

        def spread(data: DataFrame, by: Sequence[str]) -> DataFrame:
            return data.groupBy(*[cell(r) for r in by]).agg(*aggregates)

        table = spread(df, rows)
        headers = dict(types)

    def shown(header: str) -> Column:
        if headers[header] == "count":
            return cell(header)
        return round_exact(finite_or_null(cell(header)), 2).alias(header)

    table = table.select(*[cell(r) for r in rows], *[shown(h) for h in headers])
    result = table.withColumn("is_total", F.lit(False))
    if totals:
        if totals == "recompute":
            total = spread(keyed, []).select(*[shown(h) for h in headers])
        else:
            total = table.agg(*[
                (F.sum(cell(h)) if a == "count" else round_exact(F.sum(cell(h)), 2)).alias(h)
                for h, a in headers.items()
            ])
        result = result.select(
            *[cell(r).cast("string").alias(r) for r in rows], *[cell(h) for h in headers], "is_total"
        ).unionByName(total.select(
            *[F.lit("TOTAL" if i == 0 else "").alias(r) for i, r in enumerate(rows)],
            *[cell(h) for h in headers],
            F.lit(True).alias("is_total"),
        ))
    return result


def sorted_pivot(table: DataFrame, rows: Sequence[str]) -> DataFrame:
    """Display order: by the row columns, nulls first, the totals row last (PVT-1).

    A table with totals holds its row keys as text; numbers among them still sort as numbers.
    """
    terms = [F.col("is_total").asc()]
    for r in rows:
        if dict(table.dtypes)[r] == "string":
            terms += [cell(r).isNull().desc(), cell(r).try_cast("double").asc_nulls_last()]
        terms.append(cell(r).asc_nulls_first())
    return table.orderBy(*terms)
