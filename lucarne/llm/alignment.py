"""Alignment of the tokens that two tokenizers make of the same text.

Both encodings of a text spell the same bytes, so each token ends at a byte offset. A dictionary leads from each end of one side to
its token; the ends of the other side that it holds, in order, are where both tokenizers cut. They
slice the two id lists into groups that cover the same bytes, and the links of a group, all pairs of its tokens whose byte
ranges overlap, are expanded slice by slice. Texts pass through the dictionary in windows of bytes.

The first tokenizer is a byte-level BPE and encodes a space and the text; the second is a SentencePiece model, which puts that
space itself. Special tokens are ordinary text to both. Texts that are null or empty, or that the second model does not spell
byte by byte (it reads U+2581 as a space), have no tokens.

Every id pair is counted by the documents that hold it linked. Texts are encoded once, into a staged table of groups and distinct
pairs; pairs are counted from it with aggregation before the shuffle. The counts then go to the documents: the most frequent
pairs, at most ``most`` by construction, as a broadcast, and pairs beyond them, each too rare to be a hot key, by a join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.llm import bpe, pieces
from lucarne.llm.bpe import ranges, with_columns
from lucarne.llm.shared import Staging, bounded_batches, fresh, slices

#: Bytes of a text whose ends are in the dictionaries at once.
WINDOW = 1 << 20
#: Bytes of the texts that are aligned in one go.
PART = 2 << 20
#: Pairs whose counts are broadcast, 17 bytes each.
MOST = 2_000_000


def common_places(a_end: np.ndarray, b_end: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side end at or before each end that both have."""
    a_cut, b_cut = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    p = q = 0
    while p < len(a_end):
        limit = a_end[p] + window
        end_p, end_q = (int(np.searchsorted(x, limit, side="right")) for x in (a_end, b_end))
        # A dictionary from each end of the first side to its token, asked for each end of the second.
        place = pc.index_in(pa.array(b_end[q:end_q]), value_set=pa.array(a_end[p:end_p]))
        a_cut.append(place.drop_null().to_numpy() + np.int64(p + 1))
        b_cut.append(np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False)) + (q + 1))
        p, q = end_p, end_q
    return np.concatenate(a_cut), np.concatenate(b_cut)


def common_ends(a_ends: list[int], b_ends: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The same for the ends of one text as lists."""
    a_cut, b_cut = common_places(np.array(a_ends, dtype=np.int64), np.array(b_ends, dtype=np.int64), window)
    return a_cut.tolist(), b_cut.tolist()


def links(a_end: np.ndarray, b_end: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of either side that overlap, slice by slice; slice g has the tokens from cut g to cut g + 1."""
    i, j, m, n = a_cut[:-1], b_cut[:-1], np.diff(a_cut), np.diff(b_cut)
    # A slice with one token on a side links it with all of the other.
    one = (m == 1) & (n == 1)
    few, more = (m == 1) & (n > 1), (m > 1) & (n == 1)
    a_place = [i[one], np.repeat(i[few], n[few]), ranges(i[more], m[more])]
    b_place = [j[one], ranges(j[few], n[few]), np.repeat(j[more], m[more])]
    rest = (m > 1) & (n > 1)
    # In the others each end of either side ends one link.
    a_open, b_open = ranges(i[rest], m[rest]), ranges(j[rest], n[rest])
    ends = np.union1d(a_end[a_open], b_end[b_open])
    a_place.append(a_open[np.searchsorted(a_end[a_open], ends)])
    b_place.append(b_open[np.searchsorted(b_end[b_open], ends)])
    return np.concatenate(a_place), np.concatenate(b_place)


class Aligner:
    """The two tokenizers and the alignment of a batch of texts."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        self.a, self.b = bpe.loaded(byte_model), pieces._loaded(piece_model)
        # Each id of either side as it is written inside its side of a group and at its end, and of the second at the end of a text.
        names = [f"{i}{end}" for ends, size in ((",|", self.a.size), ((",", ";", ""), self.b.size)) for i in range(size) for end in ends]
        self.name = pa.array(names, type=pa.large_string())

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        """groups, n_a, n_b, n_groups, n_links, distinct pairs and how often each is linked, of all texts."""
        parts = [self._part(column.slice(begin, end - begin)) for begin, end in slices(pa.record_batch([column], ["text"]), "text", PART)]
        return [pa.concat_arrays(x) for x in zip(*(parts or [self._part(column)]), strict=True)]

    def _part(self, column: pa.Array) -> list[pa.Array]:
        texts = [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
        spaced = [" " + t if t else "" for t in texts]
        a, a_count = self.a.encode(pa.array(spaced, type=pa.large_string()), specials=False)
        b, b_count = self.b.encode(texts, ends=False)
        a, b, a_count, b_count = self._spelled("".join(spaced).encode(), a, b, a_count, b_count)
        a_end, b_end = np.cumsum(self.a.token_size[a]), np.cumsum(self.b.text_size[b])
        a_at, b_at = (np.concatenate([[0], np.cumsum(x)]) for x in (a_count, b_count))
        # Every text ends where both sides end, so all texts of the part are one line of ends.
        a_cut, b_cut = common_places(a_end, b_end)
        groups = np.diff(np.searchsorted(a_cut, a_at, side="right"))
        a_cut, b_cut = (np.concatenate([[0], x]) for x in (a_cut, b_cut))
        x, y = links(a_end, b_end, a_cut, b_cut)
        owner = np.repeat(np.arange(len(texts)), a_count)[x]
        total = self.a.size * self.b.size
        code = np.sort(owner * total + a[x] * self.b.size + b[y])
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code[at] // total, minlength=len(texts)))]).astype(np.int32))
        often = np.diff(np.append(at, len(code))).astype(np.int32)
        numbers = (a_count, b_count, groups, np.bincount(owner, minlength=len(texts)))
        return [
            self._written(a, b, a_at + b_at, a_cut, b_cut), *(pa.array(c.astype(np.int64)) for c in numbers),
            pa.ListArray.from_arrays(ends, pa.array(code[at] % total)), pa.ListArray.from_arrays(ends, pa.array(often)),
        ]

    def _spelled(self, raw: bytes, a: np.ndarray, b: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> tuple[np.ndarray, ...]:
        """The ids without those of texts that the second side does not spell; the first is cut from the bytes and always does."""
        a_size, b_size = self.a.token_size[a], self.b.text_size[b]
        b_byte = self.b.text_flat[ranges(self.b.text_at[b], b_size)]
        a_text, b_text = (np.concatenate([[0], np.cumsum(s)])[np.concatenate([[0], np.cumsum(c)])] for s, c in ((a_size, a_count), (b_size, b_count)))
        byte = np.frombuffer(raw, dtype=np.uint8)
        if np.array_equal(a_text, b_text) and np.array_equal(byte, b_byte):
            return a, b, a_count, b_count
        same = np.array([np.array_equal(byte[i:m], b_byte[j:n]) for i, m, j, n in zip(a_text, a_text[1:], b_text, b_text[1:], strict=False)])
        return a[np.repeat(same, a_count)], b[np.repeat(same, b_count)], a_count * same, b_count * same

    def _written(self, a: np.ndarray, b: np.ndarray, text_at: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> pa.Array:
        """The groups of each text: the ids of both sides in the order of their slices, each with what follows it."""
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[a_cut[1:] - 1] = b_last[b_cut[1:] - 1] = 1
        name = np.empty(len(a) + len(b), dtype=np.int64)
        name[np.arange(len(a)) + np.repeat(b_cut[:-1], np.diff(a_cut))] = 2 * a + a_last
        name[np.arange(len(b)) + np.repeat(a_cut[1:], np.diff(b_cut))] = 2 * self.a.size + 3 * b + b_last
        name[text_at[1:][np.diff(text_at) > 0] - 1] += 1
        if not len(name):
            return pa.array([""] * (len(text_at) - 1), type=pa.string())
        # Names that follow each other in a text follow each other in memory: the texts are cut from it.
        _, ends, flat = self.name.take(pa.array(name)).buffers()
        cut = np.frombuffer(ends, dtype=np.int64, count=len(name) + 1)[text_at]
        return pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), flat).cast(pa.string())


_LOADED: dict[tuple[bytes, bytes], Aligner] = {}


def _loaded(byte_model: bytes, piece_model: bytes) -> Aligner:
    key = (byte_model, piece_model)
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


def align(
    df: DataFrame, byte_model: bytes, piece_model: bytes, text: str = "text", most: int = MOST, kept: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Each row without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum (all long) and groups.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: decimal ids in order; it is several times as long as the text, and ``kept`` may name
    what to keep of it instead, such as a digest. A pair's count is the number of rows that hold it linked;
    ``n_best`` numbers the links whose count is the highest of their first id, ties included, ``count_sum`` sums the counts of all
    links. Rows without tokens have zeros and the empty text. Repeated rows count and come each by itself; an empty
    table stays empty. Other columns are kept, but for those called like the new ones, which are replaced.
    """
    spark = bounded_batches(df.sparkSession)
    staging = Staging(spark, "alignment")
    models = spark.sparkContext.broadcast((byte_model, piece_model))
    size = pieces._loaded(piece_model).size
    new = ["groups", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    carried = df.select(F.col(text).alias("groups"), *(F.col(f"`{c}`") for c in df.columns if c.lower() not in {text.lower(), *new}))
    pairs, times, row, found = (fresh(carried, name) for name in ("pairs", "times", "row", "found"))
    columns = [T.StructField("groups", T.StringType()), *(T.StructField(c, T.LongType()) for c in new[1:5])]
    columns += [T.StructField(pairs, T.ArrayType(T.LongType())), T.StructField(times, T.ArrayType(T.IntegerType()))]
    made = with_columns(carried, columns, "groups", lambda texts: _loaded(*models.value)(texts))
    held = staging.keep(made.withColumn("groups", kept(F.col("groups"))) if kept else made)

    counted = held.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / size)))
    counts, counts_at = staging.write(counted.withColumn("best", F.col("n") == highest))
    stats = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("total")).first()
    # A pair of n rows or more is one of at most total / n, so the broadcast is bounded however many pairs there are.
    least = 1 if stats["pairs"] <= most else stats["total"] // most + 1
    frequent = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy()[order] for c in ("pair", "n", "best")))

    @F.arrow_udf("struct<n_best long, count_sum long, missed int>")
    def scored(codes: pa.Array, often: pa.Array) -> pa.Array:
        pair, n, best = shared.value
        code, many = codes.flatten().to_numpy(zero_copy_only=False), often.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
        hit = pair[at] == code if len(pair) else np.zeros(len(code), dtype=bool)
        sums = [np.where(hit, x, 0) if len(pair) else np.zeros(len(code), np.int64) for x in (many * best[at] if len(pair) else 0, many * n[at] if len(pair) else 0)]
        ends = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))])
        totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (*sums, ~hit)]
        return pa.StructArray.from_arrays([pa.array(totals[0]), pa.array(totals[1]), pa.array(totals[2].astype(np.int32))], ["n_best", "count_sum", "missed"])

    result = held.withColumn(found, scored(pairs, times))
    if least > 1:
        # Pairs under ``least`` are joined; no key of this join has more rows than that.
        result = staging.keep(result.withColumn(row, F.monotonically_increasing_id()))
        open_ = result.where(f"`{found}`.missed > 0").select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(pairs).alias("pair"), F.col(times).alias("times"))).alias("x"))
        rare = counts.where(F.col("n") < least)
        sums = open_.select("row", "x.pair", "x.times").join(rare, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"), F.sum(F.col("times") * F.col("n")).alias("sum_more"),
        )
        more, best_more, sum_more = fresh(result, "row_more"), fresh(result, "best_more"), fresh(result, "sum_more")
        result = result.join(sums.select(F.col("row").alias(more), F.col("best_more").alias(best_more), F.col("sum_more").alias(sum_more)), F.col(row) == F.col(more), "left")
        n_best = F.col(f"{found}.n_best") + F.coalesce(best_more, F.lit(0))
        count_sum = F.col(f"{found}.count_sum") + F.coalesce(sum_more, F.lit(0))
    else:
        n_best, count_sum = F.col(f"{found}.n_best"), F.col(f"{found}.count_sum")
    others = [F.col(f"`{c}`") for c in carried.columns if c != "groups"]
    return result.select(*others, *new[1:5], n_best.alias("n_best"), count_sum.cast("long").alias("count_sum"), "groups")
