"""Outlier screening and row-level anomaly detection (ANO-1 to ANO-11).

Constants (moments, exact quartiles, forest) come from one or a few aggregations whose results do
not grow with the table; the detection itself is a row-local expression, so flagged rows stream
straight out of the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucarne.functions.arithmetic import one_decimal
from lucarne.functions.casts import is_numeric_type
from lucarne.functions.vocabulary import (
    METHOD_LABELS, ROW_SEVERITY, ROW_SEVERITY_ELSE, SENSITIVITY, TABLE_SEVERITY, TABLE_SEVERITY_ELSE,
)
from lucarne.operators import forest as iforest
from lucarne.operators.cleaning import cell
from lucarne.operators.filters import ordering
from lucarne.operators.inference import semantic_types
from lucarne.operators.profile import numeric_columns
from lucarne.operators.quantiles import LINEAR, NEAREST, column_quantiles
from lucarne.session import small_table, stage

TOP_CONTRIBUTORS = 2
TOP_COLUMNS = 5


def iqr_screen(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Outliers per discrete or continuous column by quartile fences; columns without any are left out (ANO-1)."""
    kinds = {
        r["column"]: r["semantic_type"] for r in semantic_types(df).collect()
        if r["semantic_type"] in ("discrete", "continuous") and is_numeric_type(r["dtype"])
    }
    names = [c for c in df.columns if c in kinds]
    schema = "column string, type string, count bigint, pct double, severity string"
    if not names:
        return small_table(df.sparkSession, [], schema)
    quartiles = column_quantiles(df, names, [0.25, 0.75], NEAREST)
    outside = []
    for c in names:
        _, (q1, q3) = quartiles.get(c, (0, (0.0, 0.0)))
        v = _number(c)
        outside.append(F.count_if((v < q1 - k * (q3 - q1)) | (v > q3 + k * (q3 - q1))))
    row = df.agg(F.count(F.lit(1)), *outside).first()
    n = row[0]
    rows = [
        (c, kinds[c], count, round(count / n * 100, 1), "high" if count > n * 0.05 else "medium")
        for c, count in zip(names, row[1:]) if count
    ]
    return small_table(df.sparkSession, rows, schema)


@dataclass
class Norm:
    """What is usual for one column: exact linear quartiles, and moments after filling nulls."""

    cells: int = 0
    median: float | None = None
    q1: float | None = None
    q3: float | None = None
    mean: float | None = None
    std: float | None = None


def _number(column: str) -> Column:
    v = cell(column).cast("double")
    return F.when(~F.isnan(v), v)


def norms(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, Norm]]:
    """Row count and the norm of each column (QNT-2, the constants of ANO-2, ANO-3 and ANO-9)."""
    aggregates = [F.count(F.lit(1))]
    for c in columns:
        v = _number(c)
        aggregates += [F.count(v), F.avg(v), F.var_pop(v)]
    row = df.agg(*aggregates).first()
    n = row[0]
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75], LINEAR)
    result = {}
    for i, c in enumerate(columns):
        cells, mean, variance = row[1 + 3 * i: 4 + 3 * i]
        if not cells:
            result[c] = Norm()
            continue
        _, (q1, median, q3) = quartiles[c]
        # Moments as if every null were the median, without a second pass over filled data.
        gaps = n - cells
        filled = (cells * mean + gaps * median) / n if gaps else mean
        squares = cells * (variance + (mean - filled) ** 2) + gaps * (median - filled) ** 2
        result[c] = Norm(cells, median, q1, q3, filled, (squares / n) ** 0.5)
    return n, result


def _outside(df: DataFrame, column: str, low: float, high: float) -> Column:
    """Below ``low`` or above ``high``, in a form the Parquet reader can check against row-group bounds.

    Whole numbers are compared with whole limits (no cast on the column); NaN, which Spark sorts
    above every number, is kept out by the second half of the upper test.
    """
    kind = dict(df.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint") and max(abs(low), abs(high)) < 2**31:
        return (cell(column) < F.lit(math.ceil(low))) | (cell(column) > F.lit(math.floor(high)))
    v = cell(column).cast("double")
    return (v < F.lit(low)) | ((v > F.lit(high)) & (v <= F.lit(float("inf"))))


def _any(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def _greatest(scores: Sequence[Column]) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def _ladder(value: Column, steps: list[tuple], last: tuple, part: int) -> Column:
    result = None
    for step in steps:
        result = F.when(value >= step[0], step[part]) if result is None else result.when(value >= step[0], step[part])
    return result.otherwise(last[part - 1])


def row_severity(score: Column) -> Column:
    """high from 0.75, moderate from 0.45, else low (ANO-6)."""
    return _ladder(score, ROW_SEVERITY, ROW_SEVERITY_ELSE, 1)


def row_severity_label(score: Column) -> Column:
    return _ladder(score, ROW_SEVERITY, ROW_SEVERITY_ELSE, 2)


def score_label(name: Column, value: Column, median: Column) -> Column:
    """How far the leading column lies from its median, in words (ANO-8)."""
    ratio = F.abs(value / F.nullif(median, F.lit(0.0)))
    apart = F.abs((value - median) / F.nullif(median, F.lit(0.0))) * 100
    return (
        F.when(name.isNull(), "Déviation détectée")
        .when(ratio.isNull(), F.concat(F.lit("Valeur atypique sur "), name))
        .when(ratio >= 2, F.concat(F.lit("×"), one_decimal(ratio), F.lit(" la médiane")))
        .otherwise(F.concat(F.rint(apart).cast("bigint").cast("string"), F.lit("% d'écart à la médiane")))
    )


@dataclass
class Detection:
    """Flagged rows of one run, and what a report says about them."""

    method: str
    columns: list[str]
    total_rows: int
    anomalies: DataFrame
    norms: dict[str, Norm] = field(default_factory=dict)

    def ordered(self, key: Sequence[str] = ()) -> DataFrame:
        """Most severe first; the key settles ties and spreads equal scores over many ranges (ANO-10)."""
        return self.anomalies.orderBy(F.desc("score"), *ordering([], key))

    def summary(self) -> DataFrame:
        """Count, rate, rows per severity, the columns most often involved, overall severity (ANO-11).

        One aggregation with a counter per analysed column; nothing is exploded or shuffled by row.
        """
        n = F.lit(self.total_rows)
        involved = [
            F.struct((-F.count_if(F.array_contains("contributing_columns", c))).alias("c"), F.lit(i).alias("i"), F.lit(c).alias("name"))
            for i, c in enumerate(self.columns)
        ]
        counted = self.anomalies.agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "moderate", "low")],
            (F.array_sort(F.array(*involved)) if involved else F.array().cast("array<struct<c:bigint,i:int,name:string>>")).alias("involved"),
        )
        rate = F.when(n > 0, F.col("anomaly_count") / n).otherwise(F.lit(0.0))
        used = F.filter("involved", lambda p: p["c"] < 0)
        return counted.select(
            F.lit(self.method).alias("method"),
            F.lit(METHOD_LABELS.get(self.method, self.method)).alias("method_label"),
            n.cast("bigint").alias("total_rows"),
            "anomaly_count",
            F.bround(rate, 6).alias("anomaly_rate"),
            _ladder(rate, TABLE_SEVERITY, TABLE_SEVERITY_ELSE, 1).alias("severity"),
            _ladder(rate, TABLE_SEVERITY, TABLE_SEVERITY_ELSE, 2).alias("severity_label"),
            "high", "moderate", "low",
            F.transform(F.slice(used, 1, TOP_COLUMNS), lambda p: p["name"]).alias("top_columns"),
        )

    def normal_ranges(self) -> DataFrame:
        """Median and quartiles of every analysed column (ANO-9)."""
        rows = [(c, n.median, n.q1, n.q3) for c, n in self.norms.items()]
        return small_table(self.anomalies.sparkSession, rows, "column string, median double, q1 double, q3 double")


def _flagged(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], known: dict[str, Norm],
    is_anomaly: Column, score: Column, column_scores: Sequence[Column],
) -> DataFrame:
    """The flagged rows with severity, score, contributors (ANO-7), label and their own values."""
    parts = F.array(*[
        F.struct(
            s.alias("s"), F.lit(i).alias("i"), F.lit(c).alias("name"), _number(c).alias("value"),
            F.lit(known[c].median).cast("double").alias("median"),
            F.lit(known[c].q1).cast("double").alias("q1"), F.lit(known[c].q3).cast("double").alias("q3"),
        )
        for i, (c, s) in enumerate(zip(columns, column_scores))
    ])
    # Descending order puts a null score last: a constant or empty column never leads.
    leading = F.slice(F.sort_array(parts, asc=False), 1, TOP_CONTRIBUTORS)
    scored = df.filter(is_anomaly).select(
        *[cell(k) for k in key],
        F.struct(*[cell(c) for c in df.columns]).alias("values"),
        score.alias("_score"),
        leading.alias("_leading"),
    )
    first = F.get("_leading", F.lit(0))
    return scored.select(
        *[cell(k) for k in key],
        row_severity(F.col("_score")).alias("severity"),
        row_severity_label(F.col("_score")).alias("severity_label"),
        F.bround("_score", 4).alias("score"),
        score_label(first["name"], first["value"], first["median"]).alias("score_label"),
        F.transform("_leading", lambda p: p["name"]).alias("contributing_columns"),
        F.map_from_entries(F.transform("_leading", lambda p: F.struct(
            p["name"], F.struct(p["median"].alias("median"), p["q1"].alias("q1"), p["q3"].alias("q3"))
        ))).alias("normal_ranges"),
        "values",
    )


def _zscore(df, key, columns, known, threshold: float) -> DataFrame:
    """Largest absolute z-score per row, population deviation, nulls read as the median (ANO-2)."""
    scores, candidates, prune = [], [], True
    for c in columns:
        norm = known[c]
        if not norm.std or not math.isfinite(norm.std):    # constant, or with an infinite cell
            scores.append(F.lit(None).cast("double"))
            continue
        filled = F.coalesce(_number(c), F.lit(norm.median))
        scores.append(F.abs((filled - F.lit(norm.mean)) / F.lit(norm.std)))
        # Whatever the rounding, a flagged value lies beyond this slightly smaller distance.
        reach = threshold * norm.std * (1 - 1e-9) - 1e-9 * abs(norm.mean)
        candidates.append(_outside(df, c, norm.mean - reach, norm.mean + reach))
        prune = prune and abs(norm.median - norm.mean) < reach    # else nulls may be flagged too
    worst = _greatest(scores)
    rows = df.filter(_any(candidates)) if prune else df
    return _flagged(rows, key, columns, known, worst > threshold, F.least(worst / (threshold * 2), F.lit(1.0)), scores)


def _iqr(df, key, columns, known, k: float) -> DataFrame:
    """Any column outside its fences; score by the largest distance from the median in IQRs (ANO-3)."""
    scores, outside = [], []
    for c in columns:
        norm = known[c]
        if norm.median is None:
            scores.append(F.lit(None).cast("double"))
            continue
        width = norm.q3 - norm.q1
        scores.append(F.abs((_number(c) - F.lit(norm.median)) / F.lit(width or 1.0)))
        outside.append(_outside(df, c, norm.q1 - k * width, norm.q3 + k * width))
    worst = _greatest(scores)
    return _flagged(df, key, columns, known, _any(outside), F.least(worst / (k * 3), F.lit(1.0)), scores)


def robust_scaled(df: DataFrame, columns: Sequence[str], known: dict[str, Norm], n: int) -> list[Column]:
    """(x - median) / IQR of the filled column, IQR 0 read as 1 (ANO-5)."""
    holes = [c for c in columns if 0 < known[c].cells < n]
    refilled = {}
    if holes:
        filled = df.select(*[F.coalesce(_number(c), F.lit(known[c].median)).alias(c) for c in holes])
        refilled = column_quantiles(filled, holes, [0.25, 0.75], LINEAR)
    scaled = []
    for c in columns:
        norm = known[c]
        if norm.median is None:
            scaled.append(F.lit(0.0))
            continue
        q1, q3 = refilled[c][1] if c in refilled else (norm.q1, norm.q3)
        scaled.append((F.coalesce(_number(c), F.lit(norm.median)) - F.lit(norm.median)) / F.lit((q3 - q1) or 1.0))
    return scaled


def _isolation_forest(df, key, columns, known, contamination: float, n: int) -> DataFrame:
    """Rows whose isolation score falls below the contamination quantile (ANO-4).

    The scores alone are staged (one double per row) to find the exact quantile and the range;
    the flagged rows are then scored again on the way out instead of writing the table a second time.
    """
    spark = df.sparkSession
    endless = [c for c in columns if known[c].cells and not math.isfinite(known[c].mean)]
    if endless:
        raise ValueError(f"the isolation forest needs finite numbers; infinite ones are in {endless}")
    scaled = robust_scaled(df, columns, known, n)
    features = df.select(*[s.alias(f"f{i}") for i, s in enumerate(scaled)])
    grown = iforest.fit(features, features.columns, n)
    raw = iforest.score(grown, spark, scaled)
    scores = stage(df.select(raw.alias("raw")))
    lo, hi = scores.agg(F.min("raw"), F.max("raw")).first()
    _, (offset,) = column_quantiles(scores, ["raw"], [contamination], LINEAR)["raw"]
    rated = df.select("*", raw.alias("_raw"))
    normal = 1 - (F.col("_raw") - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
    flagged = _flagged(
        rated, key, columns, known, F.col("_raw") < offset, normal, [F.abs(s) for s in scaled]
    )
    return flagged.withColumn("values", F.col("values").dropFields("_raw"))


def detect_anomalies(
    df: DataFrame, method: str = "zscore", sensitivity: str = "standard",
    columns: Sequence[str] = (), key: Sequence[str] = (),
) -> Detection:
    """Run one detector over the named numeric columns, or over all of them.

    ``key`` names the columns that identify a row; they are repeated beside the row's values.
    """
    if method not in METHOD_LABELS:
        raise ValueError(f"unknown method {method!r}")
    level = SENSITIVITY[sensitivity][method]
    numbers = numeric_columns(df)
    chosen = [c for c in columns if c in numbers] if columns else numbers
    if not chosen:
        return Detection(method, [], df.count(), _nothing(df, key))
    n, known = norms(df, chosen)
    if method == "zscore":
        found = _zscore(df, key, chosen, known, level)
    elif method == "iqr":
        found = _iqr(df, key, chosen, known, level)
    elif n == 0:
        found = _nothing(df, key)
    else:
        found = _isolation_forest(df, key, chosen, known, level, n)
    return Detection(method, chosen, n, found, known)


def _nothing(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """An empty result with the usual columns."""
    return df.limit(0).select(
        *[cell(k) for k in key],
        *[F.lit("").alias(c) for c in ("severity", "severity_label")],
        F.lit(0.0).alias("score"), F.lit("").alias("score_label"),
        F.array().cast("array<string>").alias("contributing_columns"),
        F.lit(None).cast("map<string,struct<median:double,q1:double,q3:double>>").alias("normal_ranges"),
        F.struct(*[cell(c) for c in df.columns]).alias("values"),
    )
