"""Isolation forest on Spark (ANO-4): trees grown in tasks from bounded subsamples, scored by batch.

One round of sampling feeds all trees. Equal points are counted first and their copies drawn by
number, so a point filling a third of the table has a third of every tree's places and costs one
row. Each tree is grown by one task from its 256 rows; the grown forest (at most 100 x 511 nodes, whatever the table) is broadcast for scoring.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucarne.functions.vocabulary import FOREST_SEED, FOREST_SUBSAMPLE, FOREST_TREES
from lucarne.operators.cleaning import cell

# Ship the helpers of this module with the task instead of expecting them on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER = 0.5772156649015329
NODES = "tree int, node int, feature int, threshold double, path double"


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    deep = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple[int, int, float, float]]:
    """Nodes ``(number, feature, threshold, path)`` of one tree; children of i are 2i+1 and 2i+2.

    Leaves have feature -1 and the path length they stand for.
    """
    nodes, open_nodes = [], [(0, 0, points)]
    while open_nodes:
        number, depth, held = open_nodes.pop()
        low, high = held.min(axis=0), held.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= depth_limit or len(held) <= 1 or not len(varying):
            nodes.append((number, -1, 0.0, float(depth + expected_path(len(held)))))
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:      # rounding up to the maximum would leave one side empty
            threshold = float(low[feature])
        left = held[:, feature] <= threshold
        nodes.append((number, feature, threshold, 0.0))
        open_nodes.append((2 * number + 1, depth + 1, held[left]))
        open_nodes.append((2 * number + 2, depth + 1, held[~left]))
    return nodes


@dataclass
class Forest:
    """Heap-ordered arrays, one row per tree; leaves are continued down to the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    depth: int
    subsample: int

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Anomaly score per row in (-1, 0], lower is more isolated."""
        count = len(points)
        flat = np.ascontiguousarray(points.T).ravel()    # one column after the other
        row = np.arange(count, dtype=np.int32)
        total = np.zeros(count)
        for feature, threshold, path in zip(self.feature * np.int32(count), self.threshold, self.path):
            at = np.zeros(count, dtype=np.int32)
            for _ in range(self.depth):
                above = flat.take(feature.take(at) + row) > threshold.take(at)
                at += at
                at += 1
                at += above
            total += path.take(at)
        mean_path = total / len(self.feature)
        whole = float(expected_path(self.subsample))
        return -np.exp2(-mean_path / (whole if whole > 0 else 1.0))


def assemble(nodes: pd.DataFrame, trees: int, depth: int, subsample: int) -> Forest:
    """Node rows to arrays; below a leaf every row keeps going left, to a copy of its path length."""
    size = 2 ** (depth + 1) - 1
    feature = np.zeros((trees, size), dtype=np.int32)
    threshold = np.full((trees, size), np.inf)
    path = np.zeros((trees, size))
    for t, n, f, thr, p in nodes.itertuples(index=False):
        if f >= 0:
            feature[t, n], threshold[t, n] = f, thr
        else:
            while True:
                path[t, n] = p
                if 2 * n + 1 >= size:
                    break
                n = 2 * n + 1
    return Forest(feature, threshold, path, depth, subsample)


def fit(df: DataFrame, features: Sequence[str], n: int, trees: int = FOREST_TREES,
        subsample: int = FOREST_SUBSAMPLE, seed: int = FOREST_SEED) -> Forest:
    """Grow a forest on the named double columns of ``df`` (``n`` rows, no nulls).

    What is drawn follows from the points and their numbers of copies alone, on any layout.
    """
    size = min(subsample, n)
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    share = min(1.0, 4.0 * trees * size / n)
    names = [f"x{i}" for i in range(len(features))]
    points = df.select(*[cell(f).alias(x) for f, x in zip(features, names)])
    points = points.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("uid", F.xxhash64(*names))
    # Each copy is in the pool with probability `share`. One hash tells which copy is the first one
    # in; a point without any ends here, and the copies after the first are drawn by their number.
    first = F.lit(-1).cast("long")
    if share < 1.0:
        even = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
        first = F.floor(F.log1p(-even) / F.lit(float(np.log1p(-share))))
    pool = points.withColumn("first", first).filter(F.col("first") < F.col("copies"))
    # Every tree draws about twice the rows it needs from the (bounded) pool and keeps `size` of them.
    keep = min(1.0, 2.0 * size / max(1.0, n * share))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            taken = np.zeros((len(batch), trees), dtype=np.int64)
            for row, (uid, copies, before) in enumerate(zip(batch["uid"], batch["copies"], batch["first"])):
                rng = np.random.default_rng([seed, int(uid) % 2**64])
                held = copies if before < 0 else 1 + rng.binomial(copies - before - 1, share)
                taken[row] = rng.binomial(held, keep, trees)
            row, tree = np.nonzero(taken)
            drawn = batch.iloc[row][["uid", *names]]
            yield drawn.assign(tree=tree.astype(np.int32), copies=taken[row, tree])

    fields = ", ".join(["uid long", *[f"{x} double" for x in names], "tree int", "copies long"])
    members = pool.mapInPandas(draw, fields)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        group = group.sort_values(["uid", *names])
        every = np.repeat(np.arange(len(group)), group["copies"])
        chosen = every[rng.permutation(len(every))[:size]]
        nodes = grow_tree(group[names].to_numpy()[chosen], rng, depth)
        result = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "path"])
        result.insert(0, "tree", tree)
        return result

    grown = members.groupBy("tree").applyInPandas(grow, NODES).toPandas()    # trees x 511 rows at most
    return assemble(grown, trees, depth, size)


def score(forest: Forest, spark, columns: Sequence[Column]) -> Column:
    """The raw score of each row as a Column, computed batch by batch."""
    # Plain arrays: a broadcast is unpickled on executors that need not have this package.
    shared = spark.sparkContext.broadcast((forest.feature, forest.threshold, forest.path, forest.depth, forest.subsample))
    chunk = 4096

    def raw(*series: pd.Series) -> pd.Series:
        points = np.column_stack([s.to_numpy(dtype=float) for s in series])
        grown = Forest(*shared.value)
        parts = [grown.scores(points[i:i + chunk]) for i in range(0, len(points), chunk)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    # The function is deterministic; saying otherwise keeps the optimizer from moving a filter on
    # the score below it and then computing the score a second time for the rows that pass.
    return F.pandas_udf(raw, "double").asNondeterministic()(*columns)
