"""The most frequent values without a shuffled row per distinct value (PRF-7, CHT-1).

A mergeable sketch of frequent items names candidates, in one scan and for all columns. Where its counts add up to the rows, it
held every value and the counts are exact: nothing else is read. Otherwise one more scan counts the candidates exactly and,
in the same aggregation, how many rows all other values of each hash bucket have together. A value that is no candidate has at
most the rows of its bucket, so where no bucket reaches the last wanted candidate, none can enter. Only the values of buckets that
reach it, if any, are counted one by one. The answer is exact in every case; the sketch decides only how much is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucarne.operators.cleaning import cell
from lucarne.session import small_table, stage

TRACKED = 4_096         # items of a sketch, at least
BUCKETS = 1 << 16       # hash buckets of the values that are no candidates
MERGERS = 256           # tasks that merge sketches before the last merge
SHORT_TEXT = 256        # longer texts are told apart by their SHA-256

COUNTS = "column string, value string, count bigint, cells bigint"


def _key(text: Column) -> Column:
    return F.when(F.length(text) <= SHORT_TEXT, text).otherwise(F.concat(F.lit("\x00"), F.sha2(text, 256)))


def _sketched(df: DataFrame, columns: Sequence[str], tracked: int) -> tuple[int, dict[str, int], dict[str, list[tuple[str | None, int]]]]:
    """Rows and one, non-null cells per column, and per column the sketch's items with their estimates; null is an item, too."""
    keyed = df.select(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("salt"), *[_key(cell(c)).alias(f"k{i}") for i, c in enumerate(columns)])
    each = range(len(columns))
    # One more row of nulls, so that there is a sketch to merge for a table without rows.
    keyed = keyed.union(df.sparkSession.range(1).select(F.lit(0), *[F.lit(None).cast("string") for _ in each]))
    first = keyed.groupBy("salt").agg(F.count(F.lit(1)).alias("n"), *[
        a for i in each for a in (F.count(f"k{i}").alias(f"c{i}"), F.expr(f"approx_top_k_accumulate(k{i}, {tracked})").alias(f"s{i}"))
    ])
    merged = first.agg(F.sum("n").alias("n"), *[
        a for i in each for a in (F.sum(f"c{i}").alias(f"c{i}"), F.expr(f"approx_top_k_combine(s{i}, {tracked})").alias(f"s{i}"))
    ])
    row = merged.select("n", *[f"c{i}" for i in each], *[F.expr(f"approx_top_k_estimate(s{i}, {tracked})").alias(f"e{i}") for i in each]).first()
    cells = {c: row[f"c{i}"] for i, c in enumerate(columns)}
    return row["n"], cells, {c: [(e["item"], e["count"]) for e in row[f"e{i}"]] for i, c in enumerate(columns)}


def top_counts(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """``(column, value, count, cells)``: the ``limit`` most frequent non-null values of each text column, smaller values first among equals.

    ``cells`` is the number of non-null cells of the column.
    """
    tracked = max(TRACKED, 2 * limit)
    rows, cells, sketches = _sketched(df, columns, tracked) if columns else (0, {}, {})
    known, open_ = [], {}
    for c, items in sketches.items():
        if sum(n for _, n in items) == rows and not any(v is not None and v.startswith("\x00") for v, _ in items):
            best = sorted(((v, n) for v, n in items if v is not None), key=lambda x: (-x[1], x[0].encode()))
            known += [(c, v, n, cells[c]) for v, n in best[:limit]]
        else:
            open_[c] = [v for v, _ in items if v is not None]
    result = small_table(df.sparkSession, known, COUNTS)
    if not open_:
        return result
    totals = F.create_map(*[F.lit(x) for c in open_ for x in (c, cells[c])])
    return result.unionByName(_proven(df, open_, limit).withColumn("cells", totals[F.col("column")]))


def _proven(df: DataFrame, candidates: dict[str, list[str]], limit: int) -> DataFrame:
    spark = df.sparkSession
    named = F.broadcast(small_table(spark, [(c, k, True) for c, keys in candidates.items() for k in keys], "column string, key string, named boolean"))
    wide = df.select(*[cell(c).cast("string").alias(c) for c in candidates])
    cells = wide.unpivot([], [cell(c) for c in candidates], "column", "value").filter(F.col("value").isNotNull()).withColumn("key", _key(F.col("value")))
    met = cells.join(named, ["column", "key"], "left")
    bucket = F.when(F.col("named").isNull(), F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    listed = F.col("named").isNotNull()
    counted = stage(met.groupBy("column", F.when(listed, F.col("key")).alias("key"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.min(F.when(listed, F.col("value"))).alias("value"),
    ))
    exact = counted.filter(F.col("bucket").isNull()).select("column", "value", "count")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count")))
    last = exact.withColumn("place", place).filter(F.col("place") == limit).select("column", F.col("count").alias("least"))
    # A bucket that only reaches the last count may hold an equal value that comes first.
    reaching = counted.filter(F.col("bucket").isNotNull()).join(F.broadcast(last), "column", "left").filter(F.col("count") >= F.coalesce("least", F.lit(1)))
    reaching = reaching.select("column", "bucket")
    if reaching.take(1):
        others = met.filter("named IS NULL").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).join(F.broadcast(reaching), ["column", "bucket"], "left_semi")
        more = others.groupBy("column", "key").agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("value")).select("column", "value", "count")
        exact = exact.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value")))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")
