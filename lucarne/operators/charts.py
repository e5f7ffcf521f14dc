"""Chart data: frequencies, sums, scatter points, box plots (CHT-1 to CHT-7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucarne.functions.casts import is_numeric_type
from lucarne.functions.vocabulary import (
    BAR_LIMIT, BOX_LIMIT, BOX_OUTLIERS, CHART_POINTS, PIE_LIMIT,
)
from lucarne.operators.cleaning import cell
from lucarne.operators.frequent import top_counts
from lucarne.operators.filters import apply_filters, drop_nulls, ordering
from lucarne.operators.quantiles import group_quantiles
from lucarne.session import small_table

CHART_TYPES = ("bar", "line", "area", "pie", "scatter", "boxplot")


def _checked(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")


def _is_number(df: DataFrame, column: str) -> bool:
    return is_numeric_type(dict(df.dtypes)[column])


def _label(column: str) -> Column:
    return cell(column).cast("string").alias("label")


def frequency(df: DataFrame, x: str, filters: Mapping[str, Any] | None = None, limit: int = CHART_POINTS) -> DataFrame:
    """Rows per value of ``x``, most frequent first (CHT-1)."""
    _checked(df, [x])
    rows = drop_nulls(apply_filters(df, filters), [x])
    found = top_counts(rows.select(_label(x)), ["label"], limit)
    return found.select(F.col("value").alias("label"), F.col("count").alias("value")).orderBy(F.desc("value"), F.asc("label")).limit(limit)


def grouped_value(
    df: DataFrame, x: str, y: str, filters: Mapping[str, Any] | None = None, limit: int = BAR_LIMIT
) -> DataFrame:
    """Sum of ``y`` per ``x`` (rows with a value where ``y`` is no number), largest first (CHT-2, CHT-3)."""
    _checked(df, [x, y])
    rows = drop_nulls(apply_filters(df, filters), [x, y])
    value = F.sum(cell(y).cast("double")) if _is_number(df, y) else F.count(cell(y)).cast("double")
    return (
        rows.groupBy(_label(x)).agg(value.alias("value"))
        .orderBy(F.desc("value"), F.asc("label")).limit(limit)
    )


def scatter(
    df: DataFrame, x: str, y: str, filters: Mapping[str, Any] | None = None,
    key: Sequence[str] = (), limit: int = CHART_POINTS, sample: bool = False, grid: int | None = None,
) -> DataFrame:
    """Points, numbers as double and the rest as text (CHT-4): the first ones, in key order if a key is named.

    ``sample=True`` takes those with the smallest hashes of their key instead: a uniform sample that is the same on any layout.
    With ``grid`` the plane between the smallest and largest x and y is cut into grid by grid cells, and every cell gives
    up to its share of the points, so that sparse regions show. Either way no task sends on more than ``limit`` points of what it reads.
    """
    _checked(df, [x, y])
    rows = drop_nulls(apply_filters(df, filters), [x, y])
    points = [cell(c).cast("double" if _is_number(df, c) else "string").alias(name) for c, name in ((x, "x"), (y, "y"))]
    if not sample:
        return (rows.orderBy(*ordering([], key)) if key else rows).limit(limit).select(*points)
    if not key:
        raise ValueError("a sample needs a key")
    drawn = [F.md5(F.concat_ws("|", *[cell(k).cast("string") for k in key])), *ordering([], key)]
    if grid is None:
        return rows.orderBy(*drawn).limit(limit).select(*points)
    if not (_is_number(df, x) and _is_number(df, y)):
        raise ValueError("a grid needs numbers on both axes")
    placed = rows.select(*points, F.struct(*[d.alias(f"d{i}") if i == 0 else cell(key[i - 1]).alias(f"d{i}") for i, d in enumerate(drawn)]).alias("drawn"))
    low_x, high_x, low_y, high_y = placed.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    at = [_step(F.col(c), lo, hi, grid).alias(n) for c, lo, hi, n in (("x", low_x, high_x, "i"), ("y", low_y, high_y, "j"))]
    place = F.row_number().over(Window.partitionBy("i", "j").orderBy("drawn"))
    return placed.select("*", *at).withColumn("place", place).filter(F.col("place") <= max(1, limit // grid**2)).select("x", "y")


def _step(value: Column, low: float | None, high: float | None, steps: int) -> Column:
    """Which of ``steps`` equal steps from ``low`` to ``high`` a value lies in; the upper end belongs to the last."""
    if low is None or high == low:
        return F.lit(0)
    return F.least(F.floor((value - low) / (high - low) * steps), F.lit(steps - 1)).cast("int")


def _boxes(df: DataFrame, x: str, y: str, filters: Mapping[str, Any] | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """The values of the first ``limit`` categories, and one row of quartiles and fences for each."""
    _checked(df, [x, y])
    if not _is_number(df, y):
        raise ValueError("a box plot needs a numeric y column")
    rows = drop_nulls(apply_filters(df, filters), [x, y])
    points = rows.select(cell(x).cast("string").alias("category"), cell(y).cast("double").alias("y"))
    # At most `limit` short rows reach the driver; a plain IN list then prunes the other passes.
    names = [r[0] for r in points.select("category").distinct().orderBy("category").limit(limit).collect()]
    points = points.filter(F.col("category").isin(names) & ~F.isnan("y")) if names else points.limit(0)
    quartiles = group_quantiles(points, "category", "y", [0.25, 0.5, 0.75]) if names else {}
    fences = []
    for name, (n, (q1, q2, q3)) in quartiles.items():
        reach = 1.5 * (q3 - q1)
        fences.append((name, n, q1, q2, q3, q1 - reach, q3 + reach))
    schema = "category string, n bigint, q1 double, q2 double, q3 double, low double, high double"
    return points, small_table(df.sparkSession, fences, schema)


def boxplot(
    df: DataFrame, x: str, y: str, filters: Mapping[str, Any] | None = None, limit: int = BOX_LIMIT
) -> DataFrame:
    """Quartiles and whiskers per category (CHT-5)."""
    points, fences = _boxes(df, x, y, filters, limit)
    inside = F.col("y").between(F.col("low"), F.col("high"))
    whiskers = (
        points.join(F.broadcast(fences.select("category", "low", "high")), "category")
        .groupBy("category")
        .agg(
            F.coalesce(F.min(F.when(inside, F.col("y"))), F.min("y")).alias("whisker_low"),
            F.coalesce(F.max(F.when(inside, F.col("y"))), F.max("y")).alias("whisker_high"),
        )
    )
    return whiskers.join(F.broadcast(fences), "category").select(
        "category", "n", "whisker_low", "q1", "q2", "q3", "whisker_high"
    )


def boxplot_outliers(
    df: DataFrame, x: str, y: str, filters: Mapping[str, Any] | None = None,
    limit: int = BOX_LIMIT, per_box: int = BOX_OUTLIERS,
) -> DataFrame:
    """Values outside the fences, the ``per_box`` farthest of each category, and how many there are (CHT-6).

    Distance counts from the nearer fence, on either side. The rank filter becomes a group limit before the shuffle, so a
    category with a third of all rows still sends at most ``per_box`` rows per task.
    """
    points, fences = _boxes(df, x, y, filters, limit)
    far = F.greatest(F.col("low") - F.col("y"), F.col("y") - F.col("high"))
    outside = points.join(F.broadcast(fences.select("category", "low", "high")), "category").withColumn("far", far).filter("far > 0")
    total = outside.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("far"), "y"))
    ranked = outside.withColumn("rank", rank).filter(F.col("rank") <= per_box)
    return ranked.join(F.broadcast(total), "category").select("category", "rank", "y", "total")    # a row per box


def chart_summary(chart: DataFrame) -> DataFrame:
    """Minimum, maximum, rounded mean, trend and the three largest bars of a chart (CHT-7).

    ``chart`` is the output of ``frequency`` or ``grouped_value``; its points are read in their
    display order, largest value first.
    """
    points = chart.orderBy(F.desc("value"), F.asc("label")).limit(CHART_POINTS)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "label")))
    top = F.transform(
        F.slice(listed, 1, 3), lambda p: F.struct(p["label"].alias("label"), (-p["v"]).alias("value"))
    )
    first, last = F.max("value"), F.min("value")
    return points.agg(
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
        F.floor(F.avg("value") + 0.5).cast("double").alias("mean"),
        F.when(first < last, "ascendant").otherwise("descendant").alias("trend"),
        top.alias("top_values"),
    )


def chart(
    df: DataFrame, chart_type: str, x: str, y: str | None = None, filters: Mapping[str, Any] | None = None,
    key: Sequence[str] = (), limit: int | None = None,
) -> DataFrame:
    """The data behind one chart: the entry point that picks among the functions above.

    ``limit`` is the number of points, bars or boxes; None takes the usual one of the chart.
    """
    size = {} if limit is None else {"limit": limit}
    if y is None:
        return frequency(df, x, filters, **size)
    if chart_type == "boxplot":
        return boxplot(df, x, y, filters, **size)
    if chart_type == "scatter":
        return scatter(df, x, y, filters, key, **size)
    return grouped_value(df, x, y, filters, **({"limit": PIE_LIMIT if chart_type == "pie" else BAR_LIMIT} | size))
