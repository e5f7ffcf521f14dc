"""Exact order statistics without sorting or gathering a column (QNT-1, QNT-2).

``percentile`` and ``median`` keep one map entry per distinct value in a single task, so they do
not survive a column of 10^12 numbers. Here a quantile sketch brackets each wanted rank, a second
pass counts what lies before each bracket and groups only the values inside it, and a running
count picks the element. Every pass is a scan with map-side combining; nothing but sketches, counts
and the values inside the (narrow) brackets is shuffled. Brackets still too full are narrowed again.

Sketches (KLL) are merged in two steps, so that hundreds of thousands of tasks do not all send
theirs to one. They are random and only estimate; the answer is exact all the same, because ranks
are counted afterwards and a bracket that missed is widened.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.operators.cleaning import cell
from lucarne.session import small_table

SKETCH = 4_000           # sketch size: 90 KB, ranks off by less than 0.1 % (99 times in 100)
SMALL_ROWS = 100_000     # groups up to this size are not sketched further but counted whole
GROUP_ROWS = 4_000_000   # values of one group that may meet in one task
GRID = 1_024             # marks per narrowing round
MERGERS = 256            # tasks that merge sketches before the last merge

NEAREST = "nearest"
LINEAR = "linear"

_INF = float("inf")


class _Missed(Exception):
    """A rank lies outside its bracket: the sketch was further off than its stated error."""


def _position(n: int, q: float, kind: str) -> tuple[int, int, float]:
    """Ranks (0-based) of the one or two elements needed, and the weight of the second."""
    h = (n - 1) * q
    if kind == NEAREST:
        k = min(n - 1, math.floor(h + 0.5))
        return k, k, 0.0
    lo = math.floor(h)
    hi = min(n - 1, lo + 1)
    return lo, hi, h - lo


def long_numbers(df: DataFrame, columns: list[str], key: str = "column", value: str = "value") -> DataFrame:
    """One row per non-null, non-NaN cell of the given numeric columns, as double."""
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = wide.unpivot([], [F.col(f"`{c}`") for c in columns], key, value)
    return long.filter(F.col(value).isNotNull() & ~F.isnan(value))


def _rank_error(size: int) -> float:
    """Published rank error of a KLL sketch (99 % confidence), as a share of n."""
    return 2.296 / size ** 0.9723


def _salt() -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("salt")


class _Numbers:
    """How values are sketched and bracketed: as doubles, or as whole numbers of 64 bits."""

    kind, low, high = "double", -_INF, _INF

    def sketch_of(self, value: Column | str, size: int) -> Column:
        return F.call_function(f"kll_sketch_agg_{self.kind}", F.col(value) if isinstance(value, str) else value, F.lit(size))

    def merged(self, sketch: str, size: int) -> Column:
        return F.call_function(f"kll_merge_agg_{self.kind}", F.col(sketch), F.lit(size))

    def marks(self, sketch: str, at: list[float]) -> Column:
        return F.call_function(f"kll_sketch_get_quantile_{self.kind}", F.col(sketch), F.array(*[F.lit(q) for q in at]))

    def sketched(self, values: DataFrame, by: list[str], value: Column, size: int) -> DataFrame:
        """``by, n, sketch``: merged per task, then by up to MERGERS tasks, then for good."""
        first = values.groupBy(*by, _salt()).agg(F.count(F.lit(1)).alias("n"), self.sketch_of(value, size).alias("sketch"))
        return first.groupBy(*by).agg(F.sum("n").alias("n"), self.merged("sketch", size).alias("sketch"))

    def brackets(self, spark: SparkSession, groups: dict) -> DataFrame:
        """One row per group: its brackets in order, null past the last."""
        width = _width(groups)
        rows = []
        for g, info in groups.items():
            ends = [e for lo, hi, _ in info["intervals"] for e in (lo, hi)]
            rows.append((g, *ends, *[None] * (2 * width - len(ends))))
        return small_table(spark, rows, "g string, " + ", ".join(f"lo{i} {self.kind}, hi{i} {self.kind}" for i in range(width)))


class _Columns(_Numbers):
    """The named columns of a table, each a group of its own."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.spark, self.columns = df.sparkSession, list(columns)
        self.df = df.select(*[self.coded(df, c).alias(f"c{i}") for i, c in enumerate(columns)])

    def coded(self, df: DataFrame, column: str) -> Column:
        value = cell(column).cast("double")
        return F.when(~F.isnan(value), value)

    def sketch(self, marks: list[float], size: int) -> list[tuple[str, int, list[float]]]:
        """One aggregation over all columns; no row is copied per column."""
        each = range(len(self.columns))
        first = self.df.groupBy(_salt()).agg(*[
            a for i in each for a in (F.count(f"c{i}").alias(f"n{i}"), self.sketch_of(f"c{i}", size).alias(f"s{i}"))
        ])
        merged = first.agg(*[
            a for i in each for a in (F.sum(f"n{i}").alias(f"n{i}"), self.merged(f"s{i}", size).alias(f"s{i}"))
        ])
        row = merged.select(*[
            a for i in each for a in (f"n{i}", F.when(F.col(f"n{i}") > 0, self.marks(f"s{i}", marks)).alias(f"m{i}"))
        ]).first()
        return [(c, row[2 * i], row[2 * i + 1]) for i, c in enumerate(self.columns) if row[2 * i]]

    def placed(self, groups: dict, ends: bool = False) -> DataFrame:
        # One short expression per row whatever the number of columns: the brackets come by a
        # broadcast with one row per column, not as literals in ever longer generated code.
        cells = self.df.select(F.posexplode(F.array(*self.df.columns)).alias("i", "v")).filter(F.col("v").isNotNull())
        index = {c: i for i, c in enumerate(self.columns)}
        names = small_table(self.spark, [(index[g], g) for g in groups], "i int, g string")
        return _place(cells, self.brackets(self.spark, groups).join(F.broadcast(names), "g"), "i", groups, ends)


class _WholeColumns(_Columns):
    """Columns of whole numbers, days, moments and decimals of up to 18 digits, each coded as a whole number in the same order."""

    kind, low, high = "bigint", -(2**63), 2**63 - 1

    def coded(self, df: DataFrame, column: str) -> Column:
        return _code(column, dict(df.dtypes)[column])


def _code(column: str, dtype: str) -> Column:
    value = cell(column)
    if dtype == "date":
        return F.unix_date(value).cast("bigint")
    if dtype in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp"))
    if dtype.startswith("decimal("):
        digits, scale = (int(x) for x in dtype[8:-1].split(","))
        if digits > 18:
            raise ValueError(f"{column} has {digits} digits; up to 18 are ordered as whole numbers")
        return (value * F.lit(10**scale).cast("decimal(19,0)")).cast("bigint")
    if dtype not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{column} is {dtype}: not a whole number, a date, a moment or a decimal")
    return value.cast("bigint")


def _decode(code: int, dtype: str) -> int | Decimal | date | datetime:
    if dtype == "date":
        return date(1970, 1, 1) + timedelta(days=code)
    if dtype in ("timestamp", "timestamp_ntz"):
        return datetime(1970, 1, 1) + timedelta(microseconds=code)
    return Decimal(code).scaleb(-int(dtype[8:-1].split(",")[1])) if dtype.startswith("decimal(") else code


class _Groups(_Numbers):
    """Groups of one column of values."""

    def __init__(self, long: DataFrame, key: str, value: str):
        self.spark = long.sparkSession
        v = F.col(value).cast("double")
        self.long = long.select(F.col(key).alias("g"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))

    def sketch(self, marks: list[float], size: int) -> list[tuple[str, int, list[float]]]:
        rows = self.sketched(self.long, ["g"], F.col("v"), size).select("g", "n", self.marks("sketch", marks).alias("m")).collect()
        return [(r["g"], r["n"], r["m"]) for r in rows]

    def placed(self, groups: dict, ends: bool = False) -> DataFrame:
        return _place(self.long, self.brackets(self.spark, groups), "g", groups, ends)


def _width(groups: dict) -> int:
    return max(len(info["intervals"]) for info in groups.values())


def _place(values: DataFrame, brackets: DataFrame, on: str, groups: dict, ends: bool) -> DataFrame:
    """``g, v, at``: how many bracket ends lie below each value.

    Every bracket counts one for ``v >= lo`` and one for ``v > hi``, so an odd number is inside
    bracket ``at // 2`` and an even one in the gap before it. With ``ends`` it counts four: modulo 4
    that is 0 in a gap, 1 on the lower end, 2 between, 3 on the upper end.
    """
    v, tests = F.col("v"), []
    for i in range(_width(groups)):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        tests += [v >= lo, v > lo, v >= hi, v > hi] if ends else [v >= lo, v > hi]
    at = reduce(Column.__add__, [F.when(t, 1).otherwise(0) for t in tests])
    return values.join(F.broadcast(brackets), on).select("g", "v", at.alias("at"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float | tuple[float, str]], kind: str = NEAREST, **limits: int):
    """``{column: (n, [quantile per prob])}`` of numeric columns; nulls and NaN are left out.

    A prob may be paired with a kind of its own. Columns without a value are missing from the
    result. Two passes for up to about 10^8 values per column, one more for each further factor of
    some hundred.
    """
    return _exact(_Columns(df, columns), probs, kind, **limits) if columns else {}


def typed_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **limits: int):
    """``{column: (n, [element per prob])}`` in each column's own type: whole numbers, dates, moments, decimals of up to 18 digits.

    Elements are nearest ranks and never pass through a double, so keys beyond 2^53 come out as they are. Nulls are left out,
    and columns without a value are missing from the result.
    """
    dtypes = dict(df.dtypes)
    found = _exact(_WholeColumns(df, columns), probs, NEAREST, **limits) if columns else {}
    return {c: (n, [_decode(v, dtypes[c]) for v in values]) for c, (n, values) in found.items()}


def approximate_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sketch: int = SKETCH):
    """``({column: (n, [element per prob])}, error)`` from one scan: the sketch's own answer (QNT-1 with ``approx=True``).

    Each element's rank is off by at most ``error`` times n, 99 times in 100; a larger ``sketch`` has a smaller error. Whole
    numbers, dates, moments and short decimals keep their type, all other numbers are doubles.
    """
    result: dict[str, tuple[int, list]] = {}
    dtypes = dict(df.dtypes)
    whole = [c for c in columns if dtypes[c] not in ("float", "double") and not (dtypes[c].startswith("decimal(") and int(dtypes[c][8:-1].split(",")[0]) > 18)]
    for source, names in ((_WholeColumns, whole), (_Columns, [c for c in columns if c not in whole])):
        for c, n, marks in source(df, names).sketch(list(probs), sketch) if names else ():
            result[c] = (n, [_decode(v, dtypes[c]) if c in whole else v for v in marks])
    return result, _rank_error(sketch)


def group_quantiles(
    long: DataFrame, key: str, value: str, probs: Sequence[float | tuple[float, str]], kind: str = NEAREST, **limits: int
):
    """``{group: (n, [quantile per prob])}`` for a *bounded* number of groups of one column."""
    return _exact(_Groups(long, key, value), probs, kind, **limits)


def _exact(
    source: _Columns | _Groups, probs: Sequence[float | tuple[float, str]], kind: str,
    sketch: int = SKETCH, small_rows: int = SMALL_ROWS, group_rows: int = GROUP_ROWS,
) -> dict[str, tuple[int, list[float]]]:
    wanted = [p if isinstance(p, tuple) else (p, kind) for p in probs]
    for widen in (4, 20, 100):
        try:
            return _bracketed(source, wanted, sketch, small_rows, group_rows, widen * _rank_error(sketch))
        except _Missed:
            continue
    # Brackets that miss three times are of no use here: rank all values.
    return _bracketed(source, wanted, sketch, 2**63, 2**63, _rank_error(sketch))


def _bracketed(
    source: _Columns | _Groups, wanted: list[tuple[float, str]], sketch: int, small_rows: int, group_rows: int, margin: float
) -> dict[str, tuple[int, list[float]]]:
    marks = sorted({min(1.0, max(0.0, q + d)) for q, _ in wanted for d in (-margin, margin)})
    groups: dict[str, dict] = {}
    for g, n, at_marks in source.sketch(marks, sketch):
        ranks = sorted({k for q, kind in wanted for k in _position(n, q, kind)[:2]})
        if n <= small_rows:
            intervals = [(source.low, source.high, ranks)]
        else:
            at = dict(zip(marks, at_marks))
            intervals = []
            for q, kind in wanted:
                lo = source.low if q - margin <= 0 else at[max(0.0, q - margin)]
                hi = source.high if q + margin >= 1 else at[min(1.0, q + margin)]
                intervals.append((lo, hi, sorted(set(_position(n, q, kind)[:2]))))
            intervals = _merge(intervals)
        inside = n if n <= small_rows else math.ceil(n * margin * 2.5 * len(intervals))
        groups[g] = {"n": n, "intervals": intervals, "inside": inside}
    if not groups:
        return {}
    # It stops paying only when the ranks lie so close together that their brackets join up.
    limit, last = max(group_rows, small_rows), _INF
    while limit < (fullest := max(g["inside"] for g in groups.values())) < last:
        last = fullest
        _narrow(source, groups, sketch, margin)
    found = _select(source, groups)
    result = {}
    for g, info in groups.items():
        values = []
        for q, kind in wanted:
            lo, hi, w = _position(info["n"], q, kind)
            a, b = found[g][lo], found[g][hi]
            values.append(a if w == 0.0 or a == b else a + (b - a) * w)
        result[g] = (info["n"], values)
    return result


def _merge(intervals: list[tuple]) -> list[tuple]:
    """Overlapping brackets become one, so that every value lies in at most one."""
    merged: list[tuple] = []
    for lo, hi, ranks in sorted(intervals, key=lambda t: (t[0], t[1])):
        if merged and lo <= merged[-1][1]:
            before = merged.pop()
            merged.append((before[0], max(before[1], hi), sorted(set(before[2]) | set(ranks))))
        else:
            merged.append((lo, hi, list(ranks)))
    return merged


def _select(source: _Columns | _Groups, groups: dict) -> dict[str, dict[int, float]]:
    """The elements at the wanted ranks: exact counts outside the brackets, values inside them."""
    counted = (
        source.placed(groups)
        .groupBy("g", "at", F.when(F.col("at") % 2 == 1, F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # A group's rows here are bounded by its bracket contents, checked before this is called.
    order = Window.partitionBy("g").orderBy("at", F.col("v").asc_nulls_first())
    running = counted.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranks = [(g, sorted({r for i in info["intervals"] for r in i[2]})) for g, info in groups.items()]
    wanted = small_table(source.spark, ranks, "g string, rs array<bigint>")
    hits = (
        running.join(F.broadcast(wanted), "g")
        .withColumn("rs", F.filter("rs", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c"))))
        .filter(F.size("rs") > 0)
        .select("g", "v", F.explode("rs").alias("r"))
        .collect()
    )
    found: dict[str, dict[int, float]] = {g: {} for g in groups}
    for h in hits:
        if h["v"] is None:
            raise _Missed(h["g"])
        found[h["g"]][h["r"]] = h["v"]
    return found


def _narrow(source: _Columns | _Groups, groups: dict, sketch: int, margin: float) -> None:
    """Sketch again between the bracket ends and shrink each bracket around its ranks.

    The ends are counted apart: a value repeated any number of times costs one group row, and
    leaving it out of the sketch is what guarantees that each round makes progress.
    """
    grid = [i / GRID for i in range(GRID + 1)]
    reach = max(2.0, margin * GRID)    # grid steps to either side, beyond the sketch error
    middle = F.col("at") % 4 == 2
    cells = (
        source.sketched(source.placed(groups, ends=True), ["g", "at"], F.when(middle, F.col("v")), sketch)
        .select("g", "at", F.col("n").alias("c"), F.when(middle, source.marks("sketch", grid)).alias("m"))
        .collect()
    )
    held = {(r["g"], r["at"]): r for r in cells}
    for g, info in groups.items():
        before, shrunk, total = 0, [], 0
        for i, (lo, hi, ranks) in enumerate(info["intervals"]):
            left = 0
            n_gap, n_lo, n_mid, n_hi = (held[g, 4 * i + p]["c"] if (g, 4 * i + p) in held else 0 for p in range(4))
            before += n_gap
            if ranks[0] < before or ranks[-1] >= before + n_lo + n_mid + n_hi:
                raise _Missed(g)
            for r in ranks:
                within = r - before - n_lo
                if lo == hi:
                    shrunk.append((lo, hi, [r]))    # one value: nothing to narrow
                elif within < 0:
                    shrunk.append((lo, lo, [r]))
                elif within >= n_mid:
                    shrunk.append((hi, hi, [r]))
                else:
                    marks = held[g, 4 * i + 2]["m"]
                    at = within / n_mid * GRID
                    a, b = math.floor(at - reach), math.ceil(at + reach)
                    shrunk.append((lo if a <= 0 else marks[a], hi if b >= GRID else marks[b], [r]))
                    left += math.ceil(n_mid * (2 * reach + 2) / GRID)
            total += min(n_mid, left)
            before += n_lo + n_mid + n_hi
        info["intervals"] = _merge(shrunk)
        info["inside"] = total
