"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document is the set of its distinct n-word shingles, held as 64-bit hashes. Documents with equal sets form one class, known by
the set's own hash, and everything below is done once per class.

Signatures. Set sizes fall into bands so that a linked pair lies in one band or two neighbouring ones. For each such pair of
bands the similarity bounds the number k of shingles in which two linked sets differ. The hash domain is cut into n1 parts, each
into three; of every part the three choices of two subparts give one signature each, a hash of band, part, choice and the
set's shingles in the chosen subparts. With 2 * n1 > k some part holds at most one difference, so two linked sets share a signature.

Candidates. Rows (signature, class) are dealt and sorted by signature and streamed; a signature of one class is dropped there.
First each class meets the first class of each of its signatures. Then the signatures that still span several components
are put together by their first class, and the classes of such a group meet in blocks of ``BLOCK``, all pairs of different components. Blocks are pairs of bounded size in tasks of their
own, and only pairs that may be linked leave them: a sketch of shingle counts per hash bin bounds the differences from below.
No bucket is capped, so no link between components is lost. Pairs inside a component are not compared further.

Every pair that links is verified on the whole sets. The result rests on 64-bit hashes of words and shingles being distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.llm.components import components
from lucarne.llm.shared import BATCH, PIECE, Staging, bounded_batches, few, files, slices

#: Classes of one group that meet about in one comparison block.
BLOCK = 512
#: Texts whose sets and sketches are made in one go, which bounds a worker's memory for short texts.
SLICE = 2048
#: Bins of the sketch; counts are cut at 255, which only loosens the bound. Pairs are first compared on sums of ``FOLD`` bins.
BINS = 512
FOLD = 4
#: Row hashes up to this number (16 MB) are broadcast to fetch texts; beyond it Spark joins.
SMALL = 2_000_000
SUBPARTS = 3
_HALF = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of words. None are kept: looking a word up takes longer than hashing it."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_sets(texts: list[bytes | None], n: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and each text's count.

    A text with fewer than n words is one shingle, its whole word sequence; without words it has none.
    """
    split = [t.lower().split() if t else [] for t in texts]  # bytes: only A-Z and the six ASCII spaces count
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = words([w for s in split for w in s])
    begin = np.cumsum(sizes) - sizes
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(texts)), count)
    start = np.repeat(begin, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(sizes, n)[owner]
    hashed = _mix(length.astype(np.uint64))
    for step in range(n):
        inside = length > step
        hashed[inside] = _mix(hashed[inside] * np.uint64(0x9E3779B97F4A7C15) + flat[start[inside] + step])
    ends = np.cumsum(count)
    for first, end in zip((ends - count).tolist(), ends.tolist(), strict=True):
        hashed[first:end].sort()  # in place, and much faster than one sort by text and hash
    keep = np.ones(len(hashed), dtype=bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[keep], np.bincount(owner[keep], minlength=len(texts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of values, modulo 2**64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def class_ids(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash per set, the same for equal sets."""
    return _mix(_sums(_mix(sets ^ np.uint64(0x5851F42D4C957F2D)), counts) + _mix(counts.astype(np.uint64)))


def sketches(sets: np.ndarray, counts: np.ndarray) -> list[bytes]:
    owner = np.repeat(np.arange(len(counts)), counts)
    bins = (_mix(sets + np.uint64(77)) & np.uint64(BINS - 1)).astype(np.int64)
    table = np.bincount(owner * BINS + bins, minlength=len(counts) * BINS)
    return [row.tobytes() for row in np.minimum(table, 255).astype(np.uint8).reshape(len(counts), BINS)]


def most_differences(a, b, percent: int):
    """Largest symmetric difference of two sets of sizes a and b that are linked."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(percent: int, largest: int) -> np.ndarray:
    """Smallest size of each band; sets that are linked lie in one band or in two neighbouring ones."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(100 * edges[-1] // percent + 1)
    edges.append(100 * edges[-1] // percent + 1)
    return np.array(edges, dtype=np.int64)


def signatures(sets: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets, and the index of the set each belongs to."""
    edges = bands(percent, int(counts.max(initial=1)))
    band = np.searchsorted(edges, counts, side="right") - 1
    out, who = [], []
    values = _mix(sets ^ np.uint64(0xA0761D6478BD642F))
    for shift in (0, 1):
        low = band - shift
        high = edges[np.maximum(low, 0) + 1] - 1
        k = most_differences(high, 100 * high // percent, percent)
        use = (counts > 0) & (low >= 0) & (k > 0)  # without differences linked sets are equal, and one class already
        parts = np.where(use, k // 2 + 1, 0)
        cells = parts * SUBPARTS
        base = np.cumsum(cells) - cells
        owner = np.repeat(np.arange(len(counts)), counts)
        mine = use[owner]
        cell = base[owner[mine]] + (((sets[mine] >> _HALF) * cells[owner[mine]].astype(np.uint64)) >> _HALF).astype(np.int64)
        # Sets are sorted, so cells are too.
        per = _sums(values[mine], np.bincount(cell, minlength=int(cells.sum()))).reshape(-1, SUBPARTS)
        chosen = per.sum(axis=1, dtype=np.uint64)[:, None] - per  # all subparts but one
        of = np.repeat(np.arange(len(counts)), parts)
        number = np.arange(len(of)) - np.repeat(base // SUBPARTS, parts)
        label = (low[of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) * np.uint64(SUBPARTS)
        label = _mix(label[:, None] + np.arange(SUBPARTS, dtype=np.uint64))
        out.append(_mix(chosen ^ label).ravel())
        who.append(np.repeat(of, SUBPARTS))
    return np.concatenate(out), np.concatenate(who)


def _chunks(batches: Iterator[pa.RecordBatch], n: int, words: Words) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the sets of their column ``text`` (binary)."""
    for batch in batches:
        for begin, end in slices(batch, "text", PIECE):
            for at in range(begin, end, SLICE):
                part = batch.slice(at, min(SLICE, end - at))
                yield part, *shingle_sets(part.column("text").to_pylist(), n, words)


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` (row, text as binary) as row, text_hash, size, class and sketch; no text leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part, sets, counts in _chunks(batches, n, words):
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("text_hash"), pa.array(counts.astype(np.int64)),
                pa.array(class_ids(sets, counts).view(np.int64)), pa.array(sketches(sets, counts), pa.binary()),
            ], ["row", "text_hash", "size", "class", "sketch"])

    row = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {row}, text_hash long, size long, class long, sketch binary")


def _all_signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, class), once per task for each class that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for _, sets, counts in _chunks(batches, n, words):
            ids = class_ids(sets, counts)
            new = np.zeros(len(counts), dtype=bool)
            for i, c in enumerate(ids.tolist()):
                if c not in seen:
                    seen.add(c)
                    new[i] = True
            sets, counts, ids = sets[np.repeat(new, counts)], counts[new], ids[new]
            sig, who = signatures(sets, counts, percent)
            for at in range(0, len(sig), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(sig[part].view(np.int64)), pa.array(ids[who[part]].view(np.int64))], ["sig", "class"])

    return docs.select("text").mapInArrow(run, "sig long, class long")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of signatures with several classes: the first class, and the place among the signature's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last row, not yet known to be shared
        lead, place = 0, 0  # of the last row
        for batch in batches:
            s = np.concatenate([sig, batch.column(0).to_numpy()])
            c = np.concatenate([cls, batch.column(1).to_numpy()])
            fresh = np.ones(len(s), dtype=bool)
            fresh[1:] = s[1:] != s[:-1]
            keep = np.ones(len(s), dtype=bool)
            keep[1:] = fresh[1:] | (c[1:] != c[:-1])  # a class that several tasks met
            s, c, fresh = s[keep], c[keep], fresh[keep]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
            first, at = c[begin], np.arange(len(s)) - begin
            if len(sig):  # the group that began in an earlier batch
                first[begin == 0], at[begin == 0] = lead, at[begin == 0] + place
            more = np.zeros(len(s), dtype=bool)
            more[:-1] = ~fresh[1:]
            out = (at > 0) | more
            out[-1] = False
            sig, cls, lead, place = s[-1:], c[-1:], int(first[-1]), int(at[-1])
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (s, c, first, at)], ["sig", "class", "lead", "place"])
        if len(sig) and place > 0:
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.array([lead]), pa.array([place])], ["sig", "class", "lead", "place"])

    return rows.repartition("sig").sortWithinPartitions("sig", "class").mapInArrow(run, "sig long, class long, lead long, place long")


def _may_link(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, at_a=None, at_b=None) -> np.ndarray:
    """False where sizes or sketches prove that two sets are not linked; ``at_a`` and ``at_b`` name the rows of the sketches."""
    at_a, at_b = (np.arange(len(size_a)) if x is None else x for x in (at_a, at_b))
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    held = 100 * low >= percent * high
    at = np.flatnonzero(held)
    for begin in range(0, len(at), 1 << 14):
        part = at[begin:begin + (1 << 14)]
        apart = np.abs(a[at_a[part]].astype(np.int16) - b[at_b[part]]).sum(axis=1)
        held[part] = apart <= most_differences(size_a[part], size_b[part], percent)
    return held


def _folded(table: np.ndarray) -> np.ndarray:
    return table.reshape(len(table), BINS // FOLD, FOLD).sum(axis=2, dtype=np.int16)


def _table(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), BINS)


def _lead_pairs(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b): a class with the first class of one of its signatures, where they may be linked."""
    pairs = shared.where("class <> lead").select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct()

    @F.pandas_udf("boolean")
    def may(size_a: pd.Series, size_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_may_link(size_a.to_numpy(), size_b.to_numpy(), _table(a), _table(b), percent))

    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.where(may("size_a", "size_b", "sketch_a", "sketch_b")).select("a", "b")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys``, cut so that no group lies in two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        table = batch[keys].to_numpy()
        last = int(np.flatnonzero((table != table[-1]).any(axis=1)).max(initial=-1)) + 1
        if last or (held and (held[-1][keys].to_numpy()[-1] != table[0]).any()):
            yield pd.concat([*held, batch[:last]], ignore_index=True)
            held = []
        held.append(batch[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _block_pairs(open_rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different components that share a group and may be linked.

    ``open_rows`` has lead, class, root, size and sketch: a group is the classes of all open signatures with the same first
    class. Signatures of near copies mostly have the same few first classes, so a pair meets a few times only.
    """
    count = open_rows.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = open_rows.join(count, "lead").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("lead", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "root", "size", "sketch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["lead", "x", "y"]):
            table = group[["lead", "x", "y"]].to_numpy()
            root, own, cls, size = (group[c].to_numpy() for c in ("root", "own", "class", "size"))
            across, sketch = table[:, 1] != table[:, 2], _table(group["sketch"])
            coarse = _folded(sketch)
            fresh = np.ones(len(group), dtype=bool)
            fresh[1:] = (table[1:] != table[:-1]).any(axis=1)
            number = np.cumsum(fresh)
            for step in range(1, len(group)):
                same = number[step:] == number[:-step]
                if not same.any():
                    break
                i = np.flatnonzero(same & (root[step:] != root[:-step]) & ~(across[step:] & (own[step:] == own[:-step])))
                for level in (coarse, sketch):
                    i = i[_may_link(size[i], size[i + step], level, level, percent, i, i + step)]
                if len(i):
                    yield pd.DataFrame({"a": np.minimum(cls[i], cls[i + step]), "b": np.maximum(cls[i], cls[i + step])})

    dealt = rows.repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, n: int, percent: int, width: int, staging: Staging) -> DataFrame:
    """The pairs of classes (a table) whose whole sets, of about ``width`` shingles, are linked, as a table."""
    asked = pairs.count()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = rows.join(needed, "class", "left_semi").groupBy("class").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct()
    wanted = staging.keep(few(wanted, 2 * asked, 8))
    number = wanted.count()
    texts = docs.join(F.broadcast(wanted) if number <= SMALL else wanted, "text_hash", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for _, sets, counts in _chunks(batches, n, words):
            ids, ends = class_ids(sets, counts).view(np.int64).tolist(), np.cumsum(counts)
            for c, end, count in zip(ids, ends.tolist(), counts.tolist(), strict=True):
                if c not in seen:
                    seen.add(c)
                    part = pa.array(sets[end - count:end].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), part)], ["class", "shingles"])

    # Copies of a text may be met by several tasks; one set per class is enough.
    sets = texts.select("text").mapInArrow(run, "class long, shingles array<long>").dropDuplicates(["class"])
    sets = staging.keep(few(sets, number, 8 * width))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("class").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b"))
    linked = pairs.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")
    return staging.keep(linked.repartition(files(asked, 16)))


def linked_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """Per row: its key, ``n_shingles`` and ``component_id``, the smallest key that it reaches by links, its own included.

    Texts are lower-cased in A-Z and cut into words at the six ASCII spaces; two texts are linked when
    100 * intersection >= percent * union of their sets of distinct ``words``-word shingles. Null and empty texts and texts
    without words have no shingles and are linked with nothing, not even with each other. Keys may repeat or be null: every row
    comes back, a null key is never the smallest, and a component without any key gets null. Other columns are ignored.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    staging = Staging(bounded_batches(df.sparkSession, BATCH), "ngram-join")
    docs = df.select(F.col(key).alias("row"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(text).cast("binary")).alias("text_hash"))
    rows = staging.keep(profiles(docs, words))
    full = rows.where("size > 0")
    held = full.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("shingles")).first()
    width = -(-held.shingles // max(1, held.rows))
    classes = full.groupBy("class").agg(F.min("row").alias("least"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = staging.keep(few(classes, held.rows, BINS + 32))
    shared = staging.keep(few(_shared(_all_signatures(docs, words, percent)), held.shingles, 32))

    pairs = staging.keep(_lead_pairs(shared, classes, percent).repartition(files(shared.count(), 16)))
    links = _verified(pairs, docs, full, words, percent, width, staging)
    roots = staging.keep(components(links, staging))

    # Pairs of classes alone in their signature have met already.
    wide = shared.where("place >= 2").select("sig").distinct()
    rooted = shared.join(wide, "sig", "left_semi").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sig")
    open_rows = rooted.join(several, "sig", "left_semi").select("lead", "class", "root").distinct().join(classes.select("class", "size", "sketch"), "class")
    rest = staging.keep(_block_pairs(open_rows, percent).join(pairs, ["a", "b"], "left_anti"))
    links = links.union(_verified(rest, docs, full, words, percent, width, staging))
    roots = staging.keep(components(links, staging))

    named = classes.select("class", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.join(smallest, "root").select("class", "component_id")
    alone = rows.where("size = 0").select(F.col("row").alias(key), F.col("size").alias("n_shingles"), F.col("row").alias("component_id"))
    return full.join(component, "class").select(F.col("row").alias(key), F.col("size").alias("n_shingles"), "component_id").union(alone)
