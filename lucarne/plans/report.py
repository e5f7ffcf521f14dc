"""The full column report: every statistic of every column, chosen by its semantic type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucarne.functions.arithmetic import percent
from lucarne.functions.casts import TEMPORAL, is_numeric_type
from lucarne.operators import profile
from lucarne.operators.inference import semantic_types
from lucarne.session import small_table


@dataclass
class ColumnReport:
    """One table per kind of statistic; each holds only the columns it applies to."""

    base: DataFrame
    numeric: DataFrame
    numeric_histogram: DataFrame
    temporal: DataFrame
    temporal_histogram: DataFrame
    categorical: DataFrame
    boolean: DataFrame
    identifier: DataFrame
    insights: DataFrame


def column_report(df: DataFrame) -> ColumnReport:
    """Statistics of all columns (PRF-1 to PRF-10).

    A numeric column without a clear type is treated as continuous, any other one as categorical.
    """
    types = semantic_types(df)
    kinds = {r["column"]: (r["semantic_type"], r["dtype"]) for r in types.collect()}

    def of(*wanted: str) -> list[str]:
        return [c for c in df.columns if kinds[c][0] in wanted]

    numeric = [c for c in of("continuous", "discrete", "numeric") if is_numeric_type(kinds[c][1])]
    temporal = [c for c in of("date", "datetime") if kinds[c][1] in TEMPORAL]
    grouped = of("categorical") + [c for c in of("numeric", "discrete") if c not in numeric]
    grouped += [c for c in of("date", "datetime") if c not in temporal]
    base = profile.base_stats(df, types=types)
    stats = profile.numeric_stats(df, numeric)
    nulls = types.select("column", percent(F.col("nulls"), F.col("count")).alias("null_pct"))
    return ColumnReport(
        base=base,
        numeric=stats,
        numeric_histogram=profile.numeric_histogram(df, numeric),
        temporal=profile.temporal_stats(df, temporal),
        temporal_histogram=profile.temporal_histogram(df, temporal),
        categorical=profile.frequent_values(df, grouped) if grouped else _none(df),
        boolean=profile.boolean_stats(df, of("boolean")) if of("boolean") else _none(df),
        identifier=profile.identifier_stats(df, of("identifier")),
        insights=profile.insights(stats.join(F.broadcast(nulls), "column")),
    )


def _none(df: DataFrame) -> DataFrame:
    return small_table(df.sparkSession, [], "column string")
