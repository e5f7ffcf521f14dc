"""Language identification by Bayesian fusion of evidence.

Text: hashed byte trigrams of letters under one multinomial per language, trained by counting all labelled rows; the log
likelihood of a long text is drawn down to that of ``WEIGHT`` independent trigrams. A language "und" with all trigrams alike
stands for texts in none of them. Declared markup language and address suffix: their likelihood under each language, from
counts against the text's own verdict over the corpus. Host: a prior smoothed towards its domain's, which is smoothed towards the
corpus's, all by grouped aggregation; a row's own verdict is left out of its host's counts.

Counts are taken over all rows. The driver sees the text model, ``BUCKETS`` numbers per language; the tables of declared
languages, suffixes, hosts and domains stay on the cluster and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucarne.llm.shared import BATCH, PIECE, Staging, bounded_batches, fresh, slices

BUCKETS = 1 << 14
#: Trigrams that a text counts for at most.
WEIGHT = 100.0
#: Positions looked at in one step, which bounds a task's memory for texts of any length.
STEP = 1 << 20
#: Bytes of a table of evidence that is broadcast.
MOVED = 16 << 20
#: Labels whose counts a training task holds at once, 128 KB each.
HELD = 64
NONE = "und"
_SPACED = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def trigrams(texts: list[str | None], letters: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of all trigrams with at most one space, in steps of bounded size.

    With ``letters`` case goes and other ASCII characters count as spaces.
    """
    rows = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED) if letters else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    rows = [b" " + r + b" " for r in rows]
    ends = np.cumsum([len(r) for r in rows])
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
    for begin in range(0, len(flat) - 2, STEP):
        part = flat[begin:begin + STEP + 2].astype(np.uint64)
        code = (part[:-2] << np.uint64(16)) | (part[1:-1] << np.uint64(8)) | part[2:]
        at = np.arange(begin, begin + len(code))
        owner = np.searchsorted(ends, at, side="right")
        space = (part == 32).astype(np.int8)
        use = (at + 2 < ends[owner]) & (space[:-2] + space[1:-1] + space[2:] < 2)
        mixed = (code[use] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
        yield owner[use], mixed.astype(np.int64)


def primary(label: Column) -> Column:
    """The primary subtag of a language tag, in lower case."""
    return F.lower(F.trim(F.regexp_extract(label.cast("string"), "^[^-_]*", 0)))


def train(df: DataFrame, text: str, label: str, least: int = 1000, smoothing: float = 0.5, max_bytes: int = 64 << 20) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of every bucket under each; the last one is ``und``.

    All rows with a label count, under its primary subtag (en-US as en). A label with fewer than ``least`` trigrams is kept and
    filled up to that number with the trigrams of all labels together; without any label only ``und`` remains. The model has
    ``BUCKETS`` numbers of four bytes per language where it is read, ``max_bytes`` in all, which is room for 1 023 languages.
    """

    def flushed(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["label", "bucket", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for begin, end in slices(batch, text, PIECE):
                part = batch.slice(begin, end - begin)
                names, which = np.unique(part.column(label).to_pylist(), return_inverse=True)
                for owner, bucket in trigrams(part.column(text).to_pylist()):
                    code, often = np.unique(which[owner] * BUCKETS + bucket, return_counts=True)
                    cuts = np.searchsorted(code, np.arange(len(names) + 1) * BUCKETS)
                    for k, name in enumerate(names.tolist()):
                        if len(counts) >= HELD and name not in counts:
                            yield from flushed(counts)
                        own = slice(cuts[k], cuts[k + 1])
                        counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))[code[own] - k * BUCKETS] += often[own]
        yield from flushed(counts)

    spark = bounded_batches(df.sparkSession, BATCH)
    labelled = df.where(F.col(label).isNotNull()).select(primary(F.col(label)).alias(label), text).where(F.col(label) != "")
    counted = labelled.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counted = Staging(spark, "language-model").keep(counted)
    most = max_bytes // (4 * BUCKETS) - 1
    names = sorted(r.label for r in counted.select("label").distinct().where(F.col("label") != NONE).limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages, for which the model would exceed {max_bytes} bytes")
    at = {name: k for k, name in enumerate(names)}
    table = np.zeros((len(names) + 1, BUCKETS))
    for r in counted.where(F.col("label") != NONE).toLocalIterator():
        table[at[r.label], r.bucket] = r.n
    corpus = table.sum(axis=0) / max(1.0, table.sum())
    thin = np.maximum(0.0, least - table[:-1].sum(axis=1))
    table[:-1] += thin[:, None] * corpus
    table += smoothing
    return [*names, NONE], np.log(table / table.sum(axis=1, keepdims=True))


def read_text(df: DataFrame, model: tuple[list[str], np.ndarray], text: Column) -> DataFrame:
    """The rows with ``likelihood`` (per language), ``best`` (its index) and ``trigrams``; only the text goes to Python, once."""
    shared = bounded_batches(df.sparkSession, BATCH).sparkContext.broadcast(model[1].astype(np.float32))

    @F.arrow_udf("struct<likelihood: array<double>, best: int, trigrams: bigint>")
    def read(texts: pa.Array) -> pa.Array:
        table = shared.value
        held, bests, counts = [], [], []
        batch = pa.record_batch([texts], ["text"])
        for begin, end in slices(batch, "text", PIECE):
            size = end - begin
            total, n = np.zeros((len(table), size)), np.zeros(size)
            for owner, bucket in trigrams(texts.slice(begin, size).to_pylist()):
                n += np.bincount(owner, minlength=size)
                for k, row in enumerate(table):
                    total[k] += np.bincount(owner, weights=row[bucket], minlength=size)
            total *= np.minimum(1.0, WEIGHT / np.maximum(n, 1))
            held.append(total.T.ravel())
            bests.append(np.where(n > 0, total.argmax(axis=0), len(table) - 1))
            counts.append(n)
        flat, best, n = (np.concatenate([*x, np.zeros(0)]) for x in (held, bests, counts))
        ends = pa.array(np.arange(0, len(flat) + 1, len(table), dtype=np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(best.astype(np.int32)), pa.array(n.astype(np.int64))], ["likelihood", "best", "trigrams"],
        )

    found = fresh(df, "found")
    return df.withColumn(found, read(text)).select(*(F.col(f"`{c}`") for c in df.columns), f"{found}.*")


def _totals(rows: DataFrame, size: int) -> list[int]:
    found = {r.best: r.n for r in rows.groupBy("best").agg(F.count("*").alias("n")).collect()}
    return [found.get(k, 0) for k in range(size)]


def _counts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Verdicts per key: an array of counts by language."""
    each = rows.groupBy(key, "best").agg(F.count("*").alias("n"))
    held = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("held"))
    count = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long")))
    return held.select(key, count.alias(f"{key}_counts"))


def _signal(rows: DataFrame, key: str, size: int, smoothing: float) -> DataFrame:
    """Log likelihood of each value of ``key`` under each language; null values are no evidence and are left out."""
    given = rows.where(F.col(key).isNotNull())
    d = max(2, given.agg(F.approx_count_distinct(key)).first()[0] or 0)
    whole = F.array(*(F.lit(float(n + smoothing * d)) for n in _totals(given, size)))
    log = F.zip_with(f"{key}_counts", whole, lambda n, of: F.log((n + smoothing) / of))
    return _counts(given, key, size).select(key, log.alias(f"{key}_log"))


def identify(
    df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", declared: Column | None = None, suffix: Column | None = None,
    host: Column | None = None, domain: Column | None = None, smoothing: float = 0.5, strength: float = 5.0, least: float = 0.5, keep_text: bool = False,
) -> DataFrame:
    """The rows, without their text unless ``keep_text``, with language, probability, trigrams and accepted; columns of these names are replaced.

    A row is accepted if its language is not ``und`` and at least as probable as ``least``. Null and empty texts and texts without
    letters are ``und`` with probability 1. Null evidence is left out; rows without a host share one prior. Equal rows get
    equal results, except that each leaves out its own verdict only. An empty table stays empty.
    """
    names, size = model[0], len(model[0])
    made = ("language", "probability", "trigrams", "accepted")
    kept = [c for c in df.columns if (keep_text or c != text) and c.lower() not in made]
    evidence = {"declared": declared, "suffix": suffix, "host": host, "domain": domain}
    boxed = fresh(df, "row")
    null = F.lit(None).cast("string")
    given = {} if keep_text else {"text": F.col(text)}
    given |= {k: (c if c is not None else null).cast("string") for k, c in evidence.items()}
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept) if kept else [F.lit(0).alias("none")]).alias(boxed), *(c.alias(k) for k, c in given.items()))
    rows = rows.withColumns({"declared": F.nullif(primary(F.col("declared")), F.lit("")), "host": F.coalesce("host", F.lit("")), "domain": F.coalesce("domain", F.lit(""))})
    staging = Staging(df.sparkSession, "language")
    rows = staging.keep(read_text(rows, model, F.col(f"{boxed}.`{text}`") if keep_text else F.col("text")).drop("text"))

    totals = np.array(_totals(rows, size), dtype=float)
    base = (totals + smoothing) / (totals.sum() + smoothing * size)
    sides = {key: _signal(rows, key, size, smoothing) for key in ("declared", "suffix")} | {key: _counts(rows, key, size) for key in ("host", "domain")}
    for key, side in sides.items():
        side = staging.keep(side)
        # A table of few keys goes to the rows; the rows, with all they carry, move only for one that is larger.
        few = 8 * size * side.count() <= MOVED
        rows = rows.join(F.broadcast(side) if few else side, key, "left")

    order = np.array(names)

    @F.pandas_udf("struct<language: string, probability: double>")
    def fuse(likelihood: pd.Series, best: pd.Series, n: pd.Series, one: pd.Series, two: pd.Series, hosts: pd.Series, domains: pd.Series) -> pd.DataFrame:
        score = np.stack(likelihood.to_list())
        for signal in (one, two):
            score += np.stack([np.zeros(size) if s is None else s for s in signal])
        near, wide = (np.stack(x.to_list()).astype(float) for x in (hosts, domains))
        own = np.eye(size)[best.to_numpy()]
        prior = (wide - own + strength * base) / (wide.sum(axis=1, keepdims=True) - 1 + strength)
        prior = (near - own + strength * prior) / (near.sum(axis=1, keepdims=True) - 1 + strength)
        score += np.log(prior)
        score -= score.max(axis=1, keepdims=True)
        share = np.exp(score)
        share /= share.sum(axis=1, keepdims=True)
        empty = n.to_numpy() == 0
        share[empty] = np.eye(size)[-1]
        pick = share.argmax(axis=1)
        return pd.DataFrame({"language": order[pick], "probability": share[np.arange(len(pick)), pick]})

    fused = rows.select(boxed, "trigrams", fuse("likelihood", "best", "trigrams", "declared_log", "suffix_log", "host_counts", "domain_counts").alias("found"))
    accepted = (F.col("found.language") != NONE) & (F.col("found.probability") >= least)
    return fused.select(*(F.col(f"{boxed}.`{c}`").alias(c) for c in kept), "found.language", "found.probability", "trigrams", accepted.alias("accepted"))


# -- evidence of web pages


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?[a-zA-Z0-9]{1,8};", " ")


def declared_language(html: Column) -> Column:
    """The language subtag of the html element's lang attribute, null without one."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def address_parts(host: Column, path: Column) -> tuple[Column, Column]:
    """Suffix evidence (the last label of the host and a two-letter first folder) and the domain (the last two labels)."""
    labels = F.split(host, r"\.")
    folder = F.regexp_extract(path, r"^/([a-z]{2})(?:/|$)", 1)
    suffix = F.when(host != "", F.concat_ws("/", F.element_at(labels, -1), folder))
    return suffix, F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")
