"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps link the neighbours of a node to the smallest of them: the larger ones in one step, the smaller ones in the
other. Each is a minimum per node, combined before its shuffle, and a join back on the node that Spark can split where a node
has very many edges; nothing gathers a node's edges. The table is written after every round, so lineage stays short, and in as
few files as its edges ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucarne.llm.shared import Staging, few


def _linked(near: DataFrame) -> DataFrame:
    """For pairs (u, v): every v, and u, with the smallest of u and its v's, where that is another node."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    others = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return own.union(others).where("a <> b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    return _linked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for every node of ``edges`` (columns a and b, of one type).

    Loops, repeated edges and nulls in either column are allowed and add nothing. No edges give an empty table. The edges are
    read twice, so they should be a table.
    """
    most = edges.count()
    edges = edges.select("a", "b").where("a <> b").distinct()
    state, before, path = None, None, None
    while True:
        edges, new_path = staging.write(few(edges, most, 16))
        if path is not None:
            staging.drop(path)
        path = new_path
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before or state.n == 0:
            break
        before, most = state, 2 * state.n  # a round adds one edge for each node at most
        edges = _small_star(_large_star(edges).distinct()).distinct()
    roots = few(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct(), state.n, 16)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
