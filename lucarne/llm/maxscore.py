"""Ranked lexical search by Block-Max MaxScore over sharded inverted indexes.

Writing. Each task turns the rows it reads into shards, cut by postings, without moving documents. A shard's list of a term is a
row: blocks of ``BLOCK`` postings as gaps and term frequencies of one, two or four bytes each, and beside them, outside the
compressed part, every block's last document and its largest gain, and the largest gain of the whole list. The index is staged
once, with the whole vocabulary; queries read only the lists of their terms.

Searching. Lists are ordered by their bound, weight times largest gain. As long as the bounds of the first few add up to less than
the k-th score so far, those lists are not essential: a document in none of the others cannot be a result. Documents are taken
in windows. The essential lists give the candidates of a window; for each candidate the maxima of the blocks that would hold
it in the other lists are added to what it has, and if the sum stays below the k-th score, it is rejected before any of these
blocks is decompressed. The rest are looked up list by list, highest bound first, and tested again before each list. Bounds are
never below true scores and ties are kept until keys decide, so no result is lost.

Number of documents, terms and document frequencies are of the whole corpus, so scores agree between shards and their best
merge exactly. All score arithmetic but the weight is in 64-bit integers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucarne.llm.bpe import ranges
from lucarne.llm.shared import Staging, bounded_batches, fresh, slices

#: Postings of a block, of a shard (about), and documents of a window.
BLOCK, POSTINGS, WINDOW = 128, 1_000_000, 4096
#: Pairs of query and term that are broadcast at once.
ASKED = 500_000
#: Letters, digits and all bytes from 0x80 on stay, A-Z in lower case; all else parts terms.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

SCHEMA = "shard long, term binary, docs long, most long, last array<int>, top array<int>, size array<int>, width binary, payload binary"
ARROW = pa.schema([
    ("shard", pa.int64()), ("term", pa.binary()), ("docs", pa.int64()), ("most", pa.int64()), ("last", pa.list_(pa.int32())), ("top", pa.list_(pa.int32())),
    ("size", pa.list_(pa.int32())), ("width", pa.binary()), ("payload", pa.binary()),
])


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def length_part(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length adds under the line, in hundredths of the mean."""
    return 75 + (25 * lengths * documents) // max(1, terms)


def gains(tf: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * part)


# -- writing


def _binary(flat: bytes, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _widths(highest: np.ndarray) -> np.ndarray:
    return np.where(highest < 1 << 8, 1, np.where(highest < 1 << 16, 2, 4))


def _packed(values: np.ndarray, block: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write the values of each block with its width, from ``at`` on."""
    first = np.searchsorted(block, np.arange(len(width)))
    place = at[block] + (np.arange(len(values)) - first[block]) * width[block]
    for w in (1, 2, 4):
        own = width[block] == w
        split = values[own].astype("<u4").view(np.uint8).reshape(-1, 4)
        for k in range(w):
            out[place[own] + k] = split[:, k]


def shard_rows(shard: int, keys: np.ndarray, part: np.ndarray, names: list[bytes], term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The rows of one shard: its documents under the null term, then each term's list."""
    order = np.argsort(term, kind="stable")  # postings come by document
    term, doc, tf = term[order], doc[order], tf[order]
    del order
    gain = gains(tf.astype(np.int64), part[doc]).astype(np.int32)  # at most a million
    opens = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    count = np.diff(np.append(opens, len(term)))
    blocks = -(-count // BLOCK)
    start = np.repeat(opens, blocks) + BLOCK * ranges(np.zeros_like(blocks), blocks)
    size = np.diff(np.append(start, len(term)))
    block = np.repeat(np.arange(len(start)), size)
    gap = np.diff(doc, prepend=doc[:1])
    gap[opens] = doc[opens] + 1
    gap_width, tf_width = _widths(np.maximum.reduceat(gap, start)), _widths(np.maximum.reduceat(tf, start))
    stored = size * (gap_width + tf_width)
    at = np.cumsum(stored) - stored
    raw = np.empty(int(stored.sum()), dtype=np.uint8)
    _packed(gap, block, gap_width, at, raw)
    _packed(tf, block, tf_width, at + size * gap_width, raw)
    block_ends = np.concatenate([[0], np.cumsum(blocks)])
    payload_ends = np.concatenate([[0], np.cumsum(stored)])[block_ends]
    lists = lambda values: pa.ListArray.from_arrays(pa.array(block_ends.astype(np.int32)), pa.array(values.astype(np.int32)))
    width = (gap_width | tf_width << 4).astype(np.uint8).tobytes()
    rows = [
        pa.array(np.full(len(opens), shard)), pa.array([names[i] for i in term[opens].tolist()], type=pa.binary()), pa.array(count),
        pa.array(np.maximum.reduceat(gain, opens)), lists(doc[start + size - 1]), lists(np.maximum.reduceat(gain, start)), lists(stored),
        _binary(width, block_ends), _binary(raw.tobytes(), payload_ends),
    ]
    none: list[int] = []
    documents = [[shard], [None], [len(keys)], [0], [none], [none], [none], [b""], [keys.astype("<i8").tobytes() + part.astype("<i8").tobytes()]]
    both = [pa.concat_arrays([pa.array(d, type=f.type), r.cast(f.type)]) for d, r, f in zip(documents, rows, ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(both, schema=ARROW)


def _indexed(batches: Iterator[pa.RecordBatch], documents: int, terms: int, postings: int) -> Iterator[pa.RecordBatch]:
    number: defaultdict[bytes, int] = defaultdict()
    held: list[tuple] = []
    made = TaskContext.get().partitionId() << 24

    def flushed() -> pa.RecordBatch:
        keys, lengths, term, doc, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return shard_rows(made, keys, length_part(lengths, documents, terms), list(number), term, doc, tf)

    rows = total = 0
    number.default_factory = number.__len__
    for batch in batches:
        for begin, end in slices(batch, "text"):
            part = batch.slice(begin, end - begin)
            words = [terms_of(t) for t in part.column("text").to_pylist()]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            item = np.fromiter((i for w in words for i in map(number.__getitem__, w)), dtype=np.int64, count=int(lengths.sum()))
            owner = np.repeat(np.cumsum(lengths > 0) - 1, lengths)
            code = np.sort(owner << 32 | item)
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            tf = np.diff(np.append(at, len(code)))
            own = lengths > 0
            keys, code = part.column("key").to_numpy()[own], code[at]
            # A posting is held in twelve bytes: places in a shard and counts in a text are below 2**31.
            held.append((keys, lengths[own], *(x.astype(np.int32) for x in (code & 0xFFFFFFFF, (code >> 32) + rows, tf))))
            rows, total = rows + len(keys), total + len(at)
            if total >= postings:
                yield flushed()
                rows, total, made = 0, 0, made + 1
                number.clear()
    if total:
        yield flushed()


# -- searching


class Postings:
    """One list of a shard; its blocks are decompressed when a document in them is asked for, and then kept."""

    def __init__(self, most: int, last: np.ndarray, top: np.ndarray, size: np.ndarray, width: bytes, payload: bytes, docs: int, part: np.ndarray):
        self.most, self.last, self.top, self.part = most, last, top, part
        self.at, self.width, self.payload, self.docs = np.concatenate([[0], np.cumsum(size)]), width, payload, docs
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of a block."""
        if b not in self.open:
            count = min(BLOCK, self.docs - b * BLOCK)
            gap_width, tf_width = self.width[b] & 15, self.width[b] >> 4
            at = int(self.at[b])
            gap = np.frombuffer(self.payload, dtype=f"<u{gap_width}", count=count, offset=at)
            tf = np.frombuffer(self.payload, dtype=f"<u{tf_width}", count=count, offset=at + count * gap_width)
            doc = np.cumsum(gap, dtype=np.int64) + (int(self.last[b - 1]) if b else -1)
            self.open[b] = doc, gains(tf.astype(np.int64), self.part[doc])
        return self.open[b]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in [low, high) and their gains."""
        first = int(np.searchsorted(self.last, low))
        beyond = min(len(self.last), int(np.searchsorted(self.last, high - 1)) + 1)
        if first >= beyond:
            return _NOTHING
        doc, gain = self._joined(range(first, beyond))
        a, b = np.searchsorted(doc, [low, high])
        return doc[a:b], gain[a:b]

    def bounds(self, doc: np.ndarray) -> np.ndarray:
        """The largest gain of the block that would hold each document, known without opening it."""
        at = np.searchsorted(self.last, doc)
        return np.where(at < len(self.last), self.top[np.minimum(at, len(self.last) - 1)], 0)

    def gain(self, doc: np.ndarray) -> np.ndarray:
        """The gain of each document, which are in order; 0 where the list has it not."""
        at = np.searchsorted(self.last, doc)
        wanted = np.unique(at[at < len(self.last)])
        if not len(wanted):
            return np.zeros(len(doc), dtype=np.int64)
        held, gain = self._joined(wanted.tolist())
        place = np.minimum(np.searchsorted(held, doc), len(held) - 1)
        return np.where(held[place] == doc, gain[place], 0)

    def _joined(self, which) -> tuple[np.ndarray, np.ndarray]:
        opened = [self.block(b) for b in which]
        return opened[0] if len(opened) == 1 else (np.concatenate([x[0] for x in opened]), np.concatenate([x[1] for x in opened]))


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Shard:
    """The lists of one shard that some query asks for."""

    def __init__(self, table: pa.Table):
        head = np.flatnonzero(pc.is_null(table["term"]).to_numpy())[0]
        whole = np.frombuffer(table["payload"][int(head)].as_py(), dtype="<i8")
        self.keys, part = whole[:len(whole) // 2], whole[len(whole) // 2:]
        table = table.filter(pc.is_valid(table["term"])).combine_chunks()
        columns = {c: table[c].to_pylist() for c in ("term", "docs", "most", "width", "payload")}
        arrays = {c: [np.asarray(x.values) for x in table[c]] for c in ("last", "top", "size")}
        self.lists = {
            term: Postings(most, last, top, size, width, payload, docs, part)
            for term, docs, most, width, payload, last, top, size in zip(*columns.values(), *arrays.values(), strict=True)
        }

    def search(self, terms: list[bytes], weights: list[int], k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best documents, best first, equal scores by key."""
        lists = sorted(((w * own.most, w, own) for t, w in zip(terms, weights, strict=True) if w > 0 and (own := self.lists.get(t))), key=lambda x: x[0])
        together = np.cumsum([bound for bound, _, _ in lists])
        keys, scores, least = _NOTHING[0], _NOTHING[1], 1
        for low in range(0, len(self.keys), window):
            others = int(np.searchsorted(together, least))  # lists that cannot make a result by themselves
            if others == len(lists):
                break
            found = np.zeros(min(window, len(self.keys) - low), dtype=np.int64)
            for _, weight, own in lists[others:]:
                doc, gain = own.between(low, low + window)
                found[doc - low] += weight * gain
            doc = np.flatnonzero(found)
            doc, score = doc + low, found[doc]
            if least > 1 and len(doc):
                doc, score = self._settled(doc, score, lists[:others], least)
            good = score >= least
            if good.any():
                keys, scores = np.concatenate([keys, self.keys[doc[good]]]), np.concatenate([scores, score[good]])
                if len(scores) > k:
                    near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    keys, scores = keys[near], scores[near]
                best = np.lexsort((keys, -scores))[:k]
                keys, scores = keys[best], scores[best]
                least = int(scores[-1]) if len(scores) == k else 1
        return keys, scores

    @staticmethod
    def _settled(doc: np.ndarray, score: np.ndarray, others: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that reach ``least`` and their whole scores; most leave by block maxima, before their blocks are opened."""
        bounds = [weight * own.bounds(doc) for _, weight, own in others]
        open_ = np.cumsum([np.zeros(len(doc), np.int64), *bounds], axis=0)
        for at in range(len(others) - 1, -1, -1):
            stay = score + open_[at + 1] >= least
            if not stay.all():
                doc, score, open_ = doc[stay], score[stay], open_[:, stay]
            if not len(doc):
                break
            score = score + others[at][1] * others[at][2].gain(doc)
        return doc, score


def _heap(queries: Broadcast, k: int) -> Callable[[pa.Table], pa.Table]:
    """The best k of a shard for all queries of a broadcast."""

    def best(table: pa.Table) -> pa.Table:
        shard = Shard(table)
        found = [(q, *shard.search(terms, weights, k)) for q, terms, weights in queries.value]
        query = np.repeat(np.array([q for q, _, _ in found], dtype=np.int64), [len(keys) for _, keys, _ in found])
        keys, scores = (np.concatenate([_NOTHING[0], *(x[part] for x in found)]) for part in (1, 2))
        return pa.table({"query": pa.array(query), "doc_id": pa.array(keys), "score": pa.array(scores)})

    return best


class Index:
    """A staged index of the rows of a table: each document of a key and a text."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", postings: int = POSTINGS):
        """Rows without key or without terms are neither found nor counted. Rows that share a key are documents each."""
        spark = bounded_batches(df.sparkSession)
        self.spark, self.staging = spark, Staging(spark, "maxscore")
        rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.array([len(terms_of(t.as_py())) for t in batch.column("text")], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])], ["documents", "terms"])

        sums = rows.select("text").mapInArrow(counted, "documents long, terms long").agg(F.sum("documents").alias("d"), F.sum("terms").alias("t")).first()
        self.documents, self.terms = documents, terms = sums.d or 0, sums.t or 0
        self.lists = self.staging.keep(rows.mapInArrow(lambda batches: _indexed(batches, documents, terms, postings), SCHEMA))

    def search(self, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = 20, asked: int = ASKED) -> DataFrame:
        """key, rank, doc_id and score (millionths of thousandths): the k best documents of every query, equal scores by smaller doc_id.

        A term that a query repeats counts as often. Query rows that share a key are one query; those without key or terms have
        no rows. Queries with fewer matches have fewer rows; a document whose score is 0 is no match.
        """
        spark, staging = self.spark, self.staging
        name = fresh(self.lists, key)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end in slices(batch, "text"):
                    part = batch.slice(begin, end - begin)
                    words = [terms_of(t) for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(np.asarray(part.column("query")), [len(w) for w in words])), pa.array([t for w in words for t in w], type=pa.binary()),
                    ], ["query", "term"])

        given = queries.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(text).cast("binary").alias("text"))
        words = staging.keep(given.mapInArrow(split, "query long, term binary").groupBy("query", "term").agg(F.count("*").alias("times")))
        wanted = staging.keep(self.lists.where(F.col("term").isNull()).union(self.lists.join(words.select("term").distinct(), "term", "left_semi").select(*self.lists.columns)))
        df = wanted.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("docs").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(self.documents) + 2) / (2 * F.col("df") + 1)))
        weighed = staging.keep(words.join(df, "term").select("query", "term", (F.col("times") * weight).alias("weight")))
        blocks = -(-weighed.count() // asked)
        results = None
        for block in range(blocks):
            own = weighed.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
            rows = own.groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).toArrow()
            heap = _heap(spark.sparkContext.broadcast([(r["query"], r["terms"], r["weights"]) for r in rows.to_pylist()]), k)
            asked_lists = wanted if blocks == 1 else wanted.where(F.col("term").isNull()).union(wanted.join(own.select("term").distinct(), "term", "left_semi").select(*wanted.columns))
            heaps = asked_lists.groupBy("shard").applyInArrow(heap, "query long, doc_id long, score long")
            order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
            ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            part = staging.keep(ranked.select(F.col("query").alias(name), "rank", "doc_id", "score"))
            results = part if results is None else results.union(part)
        empty = spark.createDataFrame([], f"`{name}` long, rank int, doc_id long, score long")
        return (results if results is not None else empty).withColumnRenamed(name, key)
