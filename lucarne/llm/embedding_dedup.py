"""Near duplicates among vectors by sorted projection passes.

Equal vectors of a label are one class. In each pass a class, less the mean of its label, gets the signs of its products with
random vectors, first sign first, as one number; classes are ordered by label and number, cut into blocks of ``window`` places, and every class is
compared with those of its own block and of the next one, so at least with ``window`` neighbours. Verified pairs are united
inside the block, and only the links to each block's smallest member leave it, at most one per class and pass. Components of
these links over all passes are found on the cluster.

The number of passes is measured for every label: from the counts of code prefixes comes the number of leading signs after which
a prefix is no more common than a window, and from the distances to the label's mean the angle of a pair at the threshold once the
mean is subtracted. Pairs at the threshold then meet with probability ``recall``. Labels of any size are handled alike. Only where the
measured angles ask for more than ``most_passes`` passes, or no number of passes tells pairs apart (a label around one dense
spot), and comparing all classes costs less than its passes, its classes meet in pairs of blocks, without a miss; ``exact``
asks for that everywhere.

Links are then counted exactly inside each component: its classes meet in pairs of blocks, each a task of bounded size,
and only counts leave it. A vector's links are all other vectors of its component at or above the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucarne.llm.components import components
from lucarne.llm.ngram_join import whole_groups
from lucarne.llm.shared import Staging

BITS = 60
#: Classes of one component that meet in one counting block.
BLOCK = 512
#: Classes of a label that meet in one block when all are compared.
MEET = 2048
#: Comparisons of a class that cost as much as one pass of it.
PASS_COST = 4096
#: Passes whose prefixes are counted, and the steps of prefix lengths.
PILOT, STEP = 3, 2


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def usable(vector: F.Column) -> F.Column:
    """True for vectors without nulls, NaN or infinite parts that are not all zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _directions(part: pd.DataFrame) -> np.ndarray:
    """The unit vectors of classes of one length, less the mean of their label."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]])
    return _unit(pd.Series(list(rows / np.abs(rows).max(axis=1)[:, None]))) - np.stack(part["centre"].to_list())


def _centres(classes: DataFrame) -> DataFrame:
    """label, size and ``centre``, the mean of the unit vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, size), part in batch.groupby(["label", "size"], sort=False):
                rows = np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]])
                total = _unit(pd.Series(list(rows / np.abs(rows).max(axis=1)[:, None]))).sum(axis=0)
                yield pd.DataFrame({"label": [label], "size": [size], "total": [total], "n": [len(part)]})

    label = classes.schema["label"].dataType.simpleString()
    sums = classes.select("label", "size", "vector").mapInPandas(run, f"label {label}, size int, total array<double>, n long")
    each = sums.select("label", "size", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "size", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    # Rounded, so that the order of summation does not show.
    mean = each.select("label", "size", F.struct("at", F.round(F.col("x") / F.col("n"), 6).alias("x")).alias("part"))
    return mean.groupBy("label", "size").agg(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["x"]).alias("centre"))


def _codes(classes: DataFrame, passes: int | None, seed: int, first: int = 0) -> DataFrame:
    """A row per class and pass with its sign code and its distance from the centre.

    ``classes`` has label, size, id, vector and centre; without ``passes``, its column of that name says how many a class gets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for (size, count), part in batch.groupby(["size", "passes"]):
                rows = _directions(part)
                far = np.linalg.norm(rows, axis=1)
                for p in range(first, first + int(count)):
                    planes = np.random.default_rng([seed, size, p]).standard_normal((size, BITS))
                    code = (rows @ planes > 0) @ weights
                    yield pd.DataFrame({"pass": p, "label": part["label"], "size": size, "code": code, "far": far, "id": part["id"], "vector": part["vector"]})

    label, kind = classes.schema["label"].dataType.simpleString(), classes.schema["vector"].dataType.simpleString()
    many = F.col("passes").cast("long") if passes is None else F.lit(passes).cast("long").alias("passes")
    given = classes.select("label", "size", "id", "vector", "centre", many)
    return given.mapInPandas(run, f"pass int, label {label}, size int, code long, far double, id long, vector {kind}")


def _measured(classes: DataFrame, staging: Staging, threshold: float, window: int, recall: float, seed: int) -> DataFrame:
    """label, size and ``passes``, null where the measured codes do not tell pairs apart at all.

    Half of the misses that ``recall`` allows are for classes in the densest places and the closest to the centre, which are
    left out of the measures; the passes follow from the worst of the others.
    """
    miss = (1 - recall) / 2
    pilot = staging.keep(_codes(classes, PILOT, seed, first=1 << 20).drop("vector"))
    lengths = F.sequence(F.lit(0), F.lit(BITS), F.lit(STEP))
    prefix = pilot.select("pass", "label", "size", "code", F.explode(lengths).alias("length"))
    prefix = prefix.withColumn("prefix", F.expr(f"shiftright(code, {BITS} - length)"))
    groups = prefix.groupBy("pass", "label", "size", "length", "prefix").agg(F.count("*").alias("n"))
    apart = groups.groupBy("label", "size", "length").agg((F.sum(F.when(F.col("n") <= window, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    signs = apart.where(F.col("share") >= 1 - miss).groupBy("label", "size").agg(F.min("length").alias("signs"))
    near = pilot.groupBy("label", "size").agg(F.percentile_approx("far", F.lit(miss), F.lit(10000)).alias("near"))
    # Two points no nearer to the centre than ``near`` and no further apart than the threshold allows.
    angle = 2 * F.asin(F.least(F.lit(1.0), math.sqrt(2 - 2 * threshold) / (2 * F.greatest("near", F.lit(1e-9)))))
    met = F.pow(1 - angle / math.pi, F.col("signs"))
    needed = F.when(met >= 1 - miss, 1).when(met > 1e-9, F.ceil(math.log(miss) / F.log1p(-met)))
    return signs.join(near, ["label", "size"]).select("label", "size", needed.cast("long").alias("passes"))


def _all_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes with the smallest class that they are linked to, over all pairs of blocks of a label.

    ``classes`` has label, size, n (classes of that label and size), id and vector.
    """
    blocks = F.ceil(F.col("n") / MEET)
    dealt = classes.withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pairs = pairs.select("label", "size", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "vector")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["label", "size", "x", "y"]):
            for (_, _, x, y), part in group.groupby(["label", "size", "x", "y"], sort=False):
                unit, ids, own = _unit(part["vector"]), part["id"].to_numpy(), part["own"].to_numpy()
                left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
                linked = unit[left] @ unit[right].T >= threshold
                one, two = np.nonzero(np.triu(linked, 1) if x == y else linked)
                found = _smallest(ids, left[one], right[two])
                if found is not None:
                    yield found

    rows = pairs.repartition("label", "size", "x", "y").sortWithinPartitions("label", "size", "x", "y")
    return rows.mapInPandas(run, "a long, b long")


def _smallest(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame | None:
    """(a, b) of every row of ``ids`` that links x-y join to a smaller one, with the smallest."""
    if not len(x):
        return None
    rank = np.argsort(np.argsort(ids))
    by_rank = np.sort(ids)
    x, y = rank[x], rank[y]
    root = np.arange(len(ids))
    while True:  # smallest reachable row by repeated minimum
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    linked = root != np.arange(len(ids))
    return pd.DataFrame({"a": by_rank[linked], "b": by_rank[root[linked]]})


def _ordered(rows: DataFrame, staging: Staging, window: int) -> DataFrame:
    """Rows with their block: ``window`` places of the order by pass, label and code.

    Rows are sorted by range; a row's place is its place in its range plus the sizes of the ranges before, one number each.
    """
    order = ["pass", "label", "size", "code", "id"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part, at = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")
    placed = staging.keep(sorted_rows.select("*", part, at))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    block = F.floor((F.col("start") + F.col("at")) / window)
    return placed.join(F.broadcast(starts), "part").select("pass", "label", "size", "id", "vector", block.alias("own"))


def _met(ordered: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes with the smallest class that they are linked to through a block and the next one."""
    twice = ordered.withColumn("block", F.explode(F.array(F.col("own"), F.col("own") - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["block"]):
            for (_, _, _, size), part in group.groupby(["block", "pass", "label", "size"], sort=False):
                if len(part) < 2:
                    continue
                unit, ids, own = _unit(part["vector"]), part["id"].to_numpy(), part["own"].to_numpy()
                x, y = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
                later = part["block"].to_numpy()[0] + 1
                new = ~((own[x] == later) & (own[y] == later))  # those meet in the next block
                x, y = x[new], y[new]
                found = _smallest(ids, x, y)
                if found is not None:
                    yield found

    dealt = twice.repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(run, "a long, b long")


def _links(classes: DataFrame, staging: Staging, threshold: float, window: int, recall: float, seed: int, most_passes: int, exact: bool) -> DataFrame:
    """(a, b): linked classes, enough to join all components."""
    sized = classes.select("label", F.size("vector").alias("size"), "id", "vector")
    counts = staging.keep(sized.groupBy("label", "size").agg(F.count("*").alias("n")))
    if exact:
        return _all_pairs(sized.join(counts, ["label", "size"]), threshold)
    centred = staging.keep(sized.join(_centres(sized), ["label", "size"]))
    plan = counts.join(_measured(centred, staging, threshold, window, recall, seed), ["label", "size"], "left")
    in_passes = (F.col("passes") <= most_passes) | (F.col("n") > F.col("passes") * PASS_COST)
    plan = staging.keep(plan.select("label", "size", "n", F.when(in_passes, F.col("passes")).alias("passes")))
    coded = _codes(centred.join(plan.where(F.col("passes").isNotNull()).drop("n"), ["label", "size"]), None, seed)
    links = _met(_ordered(coded.drop("far"), staging, window), threshold)
    outright = plan.where(F.col("passes").isNull()).drop("passes")
    return links.unionByName(_all_pairs(sized.join(outright, ["label", "size"]), threshold)) if outright.take(1) else links


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``links`` per class: the copies of other classes of its component at or above the threshold.

    ``members`` has root, id, copies and vector, of components with several classes.
    """
    size = members.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    # Classes fall into blocks by hash; no component is ordered or gathered.
    dealt = members.join(size, "root").withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pairs = pairs.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "copies", "vector")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["root", "x", "y"]):
            for (_, x, y), part in group.groupby(["root", "x", "y"], sort=False):
                unit, own, copies = _unit(part["vector"]), part["own"].to_numpy(), part["copies"].to_numpy()
                linked = unit @ unit.T >= threshold
                np.fill_diagonal(linked, False)
                if x != y:
                    linked &= own[:, None] != own[None, :]
                yield pd.DataFrame({"id": part["id"], "links": linked @ copies})

    rows = pairs.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInPandas(run, "id long, links long")
    return rows.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, window: int = 64, recall: float = 0.995, seed: int = 7,
    most_passes: int = 256, exact: bool = False,
) -> DataFrame:
    """Per row: key, ``n_links``, ``component_id`` (the smallest key reachable by links, itself included) and ``kept``.

    Vectors are compared within a label and a length, by cosine in double precision. Rows whose label is null, whose vector is
    null, empty, zero or holds a null, NaN or infinite part are linked with nothing. Copies of a vector are linked to each
    other. Keys should be distinct; rows that repeat a key each count as a vector of their own. A null key is kept apart:
    no links, null component, not kept. An empty table stays empty.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    staging = Staging(df.sparkSession, "embedding-dedup")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    good = F.col("key").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    # Cosines do not change with the sign of a zero.
    clean = rows.where(good).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")))
    classes = staging.keep(clean.groupBy("label", "vector").agg(F.min("key").alias("id"), F.count("*").alias("copies")))
    links = staging.keep(_links(classes, staging, threshold, window, recall, seed, most_passes, exact).distinct())
    roots = staging.keep(components(links, staging))
    members = classes.join(roots.withColumnRenamed("node", "id"), "id").select("root", "id", "copies", "vector")
    counts = _link_counts(members, threshold)
    known = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = clean.join(known, ["label", "vector"]).select("key", "n_links", "component_id")
    alone = rows.where(~good).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    result = linked.unionByName(alone)
    return result.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
