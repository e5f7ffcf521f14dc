"""Mixing sources to target weights by entropy balancing.

Every document may be taken zero, one or two times (``most``). Over all such choices with the wanted words per source, the
one closest in relative entropy to "each copy by a fair coin" gives document i of source s the expected copies
``most / (1 + exp(-lambda_s * size_i / scale_s))``: rates tilted exponentially in the size. The lambdas solve a convex dual, one
dimension per source, by Newton steps kept inside a bracket. Rates depend on source and size only, so gradient and
curvature are grouped sums over the table of (source, size) counts; documents are read once for it and once for the result.

Rates become copies by systematic rounding: within a source the rates are added up in the order of size, and a document
gets as many copies as whole numbers are passed at it. The words taken then miss the balanced sum by less than the source's
largest document. The running sum needs no ordered pass over a source: it is the sum over smaller sizes plus
the rate times the document's place among those of its size, and places are counted in buckets of bounded expected size.

Everything is DataFrame and SQL functions. One row per source passes through one task (the order of the source names and the
sharing of targets); no other step gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.llm.shared import WORD, Staging, few, fresh

#: Expected documents of one size in one counting bucket.
BUCKET = 4096
#: Largest exponent; beyond it a rate is its limit in double precision.
FAR = 700.0
MAX_STEPS = 200


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``target`` per source: ``share`` of all sizes by weight, at most ``most`` times the source's size, the rest shared on.

    ``sources`` has source and source_size, one row each. Sharing the excess again and again ends where the sources whose
    limit is smallest for their weight are full and all others get one and the same amount per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    named = sources.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    named = named.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    named = named.withColumns({"level": left / F.sum("weight").over(onward), "place": F.row_number().over(by_limit)})
    named = named.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    # The level of the first source that is not full holds for all after it.
    level = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("weight") * level, "limit"))
    return named.withColumn("target", target).drop("weight", "limit", "level", "place", "full")


def rate(lam: Column, size: Column, scale: Column, most: float) -> Column:
    """Expected copies; a null lambda is an infinite one, all copies."""
    power = F.greatest(F.least(-lam * size / scale, F.lit(FAR)), F.lit(-FAR))
    return F.when(lam.isNull(), F.lit(float(most))).otherwise(F.lit(float(most)) / (1 + F.exp(power)))


def balance(counts: DataFrame, targets: DataFrame, staging: Staging, most: float = 2.0, tolerance: float = 1e-8) -> DataFrame:
    """``lam`` and ``scale`` per source so that the expected words meet the target; ``lam`` is null where all copies are needed.

    ``counts`` has src, size and n, ``targets`` src, source_size and target. Sources without words and full ones need no step.
    """
    mean = counts.groupBy("src").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    still = (F.col("source_size") <= 0) | (F.col("target") >= most * F.col("source_size"))
    null = F.lit(None).cast("double")
    state, path = staging.write(targets.join(mean, "src").select(
        "src", "target", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("scale"),
        F.when(~still, F.lit(0.0)).alias("lam"), null.alias("low"), null.alias("high"), still.alias("done"),
    ))
    for _ in range(MAX_STEPS):
        if state.where(~F.col("done")).isEmpty():
            return state.select("src", "lam", "scale")
        size, r = F.col("size").cast("double"), rate(F.col("lam"), F.col("size"), F.col("scale"), most)
        sums = counts.join(state.where(~F.col("done")), "src").select(
            "src", (F.col("n") * size * r).alias("words"), (F.col("n") * size * size / F.col("scale") * r * (1 - r / most)).alias("slope"),
        ).groupBy("src").agg(F.sum("words").alias("words"), F.sum("slope").alias("slope"))
        (state, new_path), old = staging.write(_stepped(state.join(sums, "src", "left"), tolerance)), path
        staging.drop(old)
        path = new_path
    raise RuntimeError("the balance did not settle")


def _stepped(both: DataFrame, tolerance: float) -> DataFrame:
    """One Newton step per source, kept inside the bracket; without a bracket it at most triples the distance from zero."""
    lam, gap = F.col("lam"), F.col("words") - F.col("target")
    low = F.when(gap < 0, lam).otherwise(F.col("low"))
    high = F.when(gap > 0, lam).otherwise(F.col("high"))
    reach = F.greatest(F.lit(1.0), 2 * F.abs(lam))
    downhill = F.when(gap > 0, lam - reach).otherwise(lam + reach)
    newton = F.coalesce(F.when(F.col("slope") > 0, lam - gap / F.col("slope")), downhill)
    newton = F.greatest(F.least(newton, lam + reach), lam - reach)
    inside = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
    step = F.when(inside, newton).otherwise((low + high) / 2)
    # A bracket without a number inside, or rates at their limits, are as near as doubles come.
    settled = (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (step == lam) | (F.abs(lam) > 1e12)
    moving = ~F.col("done") & ~settled
    return both.select(
        "src", "target", "scale", F.when(moving, step).otherwise(lam).alias("lam"), F.when(moving, low).otherwise(F.col("low")).alias("low"),
        F.when(moving, high).otherwise(F.col("high")).alias("high"), F.coalesce(~moving, F.lit(True)).alias("done"),
    )


def mix(df: DataFrame, size: Column, source: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """Each row with size, source_size, target, rate, copies and taken (copies times size); columns of these names are replaced.

    ``size`` is the row's number of words (null: 0, and so are negative ones). Sources in code point order, null last, get the
    weights in turn. Rows of size 0 take nothing; their rate is that of their source's tilt at 0. Rows are told apart by all
    their columns; rows that are equal in all of them are interchangeable, so runs agree. An empty table stays empty.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    kept = [c for c in df.columns if c.lower() not in made]
    hashed = [F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(c) for c in kept]
    src, mixed, bucket = (fresh(df, name) for name in ("src", "mixed", "bucket"))
    rows = df.withColumn("size", F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0).cast("long"))).select(
        *kept, "size", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias(src), F.xxhash64(*hashed).alias(mixed),
    )
    staging = Staging(df.sparkSession, "mixing")
    thin = staging.keep(rows.select(F.col(source).cast("string").alias("source"), F.col(src).alias("src"), "size", F.col(mixed).alias("mixed")))
    counts = staging.keep(few(thin.groupBy("src", "size").agg(F.count("*").alias("n")), thin.count(), 32))
    sources = thin.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = staging.keep(shared_targets(sources, list(weights), share, most))
    balanced = balance(counts, targets.select("src", "source_size", "target"), staging, most)

    rated = counts.join(balanced, "src").join(targets.select("src", "source_size", "target"), "src")
    rated = rated.withColumn("rate", rate(F.col("lam"), F.col("size"), F.col("scale"), most))
    smaller = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0.0)))

    buckets = max(1, -(-(counts.agg(F.max("n")).first()[0] or 1) // BUCKET))
    dealt = F.pmod(F.col("mixed"), F.lit(buckets))
    earlier = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = thin.groupBy("src", "size", dealt.alias("bucket")).agg(F.count("*").alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    starts = starts.join(rated.drop("n", "lam", "scale"), ["src", "size"])
    starts = starts.select(F.col("src").alias(src), "size", F.col("bucket").alias(bucket), "start", "source_size", "target", "rate", "before")

    rows = rows.withColumn(bucket, F.pmod(F.col(mixed), F.lit(buckets)))
    own = F.row_number().over(Window.partitionBy(src, "size", bucket).orderBy(mixed))
    place, start, before = (fresh(df, name) for name in ("place", "start", "before"))
    placed = rows.withColumn(place, own).join(starts.withColumnsRenamed({"start": start, "before": before}), [src, "size", bucket])
    passed = F.floor(F.col(before) + (F.col(place) + F.col(start)) * F.col("rate") + 0.5)
    earlier_passed = F.floor(F.col(before) + (F.col(place) + F.col(start) - 1) * F.col("rate") + 0.5)
    copies = F.least(F.greatest(passed - earlier_passed, F.lit(0)), F.lit(most)).cast("long")
    return placed.select(*kept, "size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Every row of a mix as often as its copies say; rows without copies go."""
    times = fresh(mixed, "time")
    wanted = mixed.where("copies > 0").withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return wanted.drop(times)
