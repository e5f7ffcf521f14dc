"""A quality classifier by co-training two views.

The text view sees hashed byte trigrams, the metadata view declared language, source, length and layout figures. Both are
naive Bayes models, so that a round of training is one count over the corpus. Round 0 counts labelled documents. In each
further round every unlabelled document that one view is confident about counts, with its pseudo-label, for the other view: the
views exchange what they know, and each starts its counts anew from the labels and the other's pseudo-labels.

A fifth of the labelled documents is held out of all rounds. On it each view's score is calibrated by a logistic curve; the
combined log odds are the sum of both views', less the prior they share. Every document is scored.

At most ``most_labels`` labels are used, chosen by a hash of the id; they are broadcast. All else covers all documents. The
driver sees the counts, a fixed number per view, and the scores of held-out documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.llm.language import BUCKETS, trigrams
from lucarne.llm.shared import Staging, slices

META = 1 << 12
WEIGHT = 100.0
_ASCII = bytes(range(128))
_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))
_DIGITS, _SPACES = bytes(range(48, 58)), b" \t\n\x0b\f\r"
_OTHER = bytes(b for b in _ASCII if b not in _LOWER + _UPPER + _DIGITS + _SPACES)


def layout(text: str | None) -> list[str]:
    """Binned figures of a text: size, words, lines, and shares of kinds of characters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    size, n = max(1, len(raw)), max(1, len(words))
    share = {k: len(raw) - len(raw.translate(None, chars)) for k, chars in (("upper", _UPPER), ("digit", _DIGITS), ("other", _OTHER), ("space", _SPACES))}
    return [
        f"size {len(raw).bit_length()}", f"words {int(8 * len(raw) / n) // 8 if len(raw) / n < 40 else 40}", f"distinct {int(10 * len(set(words)) / n)} {min(6, n.bit_length())}",
        f"lines {int(np.log2(1 + n / (1 + raw.count(b'\n'))))}", *(f"{k} {int(np.sqrt(400 * v / size))}" for k, v in share.items()),
    ]


def _metadata(texts: list, columns: list[list]) -> tuple[np.ndarray, np.ndarray]:
    owner, bucket = [], []
    for i, text in enumerate(texts):
        names = layout(text) + [f"column {k} {values[i]}" for k, values in enumerate(columns)]
        owner += [i] * len(names)
        bucket += [xxhash.xxh3_64_intdigest(x) % META for x in names]
    return np.array(owner, dtype=np.int64), np.array(bucket, dtype=np.int64)


@dataclass
class Views:
    """Log odds of good against bad per bucket, and the prior's."""

    text: np.ndarray
    meta: np.ndarray
    prior: float

    @staticmethod
    def fitted(counts: dict[str, np.ndarray], prior: float, smoothing: float = 1.0) -> Views:
        odds = {}
        for view, table in counts.items():
            share = (table + smoothing) / (table + smoothing).sum(axis=1, keepdims=True)
            odds[view] = np.log(share[1] / share[0])
        return Views(odds["text"], odds["meta"], prior)


def scored(views: Views, texts: list, columns: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of every document under each view, the prior included."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, bucket in trigrams(texts, letters=False):
        total += np.bincount(owner, weights=views.text[bucket], minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    owner, bucket = _metadata(texts, columns)
    return total * np.minimum(1, WEIGHT / np.maximum(n, 1)) + views.prior, np.bincount(owner, weights=views.meta[bucket], minlength=len(texts)) + views.prior


def _counted(docs: DataFrame, names: list[str], labels, held, views: Views | None, confident: float) -> dict[str, np.ndarray]:
    """Bucket counts by class for each view, over labelled and, given views, pseudo-labelled documents."""
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out, now = labels.value, held.value, shared.value
        counts = {"text": np.zeros((2, BUCKETS)), "meta": np.zeros((2, META))}
        for batch in batches:
            for begin, end in slices(batch, "text", 1 << 20):
                part = batch.slice(begin, end - begin)
                given = np.array([-2 if k in out else known.get(k, -1) for k in part.column("key").to_pylist()])
                at = np.flatnonzero(given >= 0 if now is None else given > -2)
                if not len(at):
                    continue
                part, given = part.take(pa.array(at)), given[at]
                texts, columns = part.column("text").to_pylist(), [part.column(c).to_pylist() for c in names]
                label = {"text": given, "meta": given}
                if now is not None:
                    scores = dict(zip(("meta", "text"), scored(now, texts, columns), strict=True))  # each view learns from the other
                    label = {v: np.where(given >= 0, given, np.where(s > confident, 1, np.where(s < -confident, 0, -1))) for v, s in scores.items()}
                for view, steps, width in (("text", trigrams(texts, letters=False), BUCKETS), ("meta", [_metadata(texts, columns)], META)):
                    for owner, bucket in steps:
                        mine = label[view][owner]
                        use = mine >= 0
                        counts[view] += np.bincount(mine[use] * width + bucket[use], minlength=2 * width).reshape(2, width)
        for view, table in counts.items():
            y, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([view] * len(y), pa.string()), pa.array(y.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(table[y, b])], ["view", "y", "bucket", "n"],
            )

    rows = docs.mapInArrow(run, "view string, y int, bucket int, n double").groupBy("view", "y", "bucket").agg(F.sum("n").alias("n"))
    counts = {"text": np.zeros((2, BUCKETS)), "meta": np.zeros((2, META))}
    for r in Staging(docs.sparkSession, "quality-model").keep(rows).toLocalIterator():
        counts[r.view][r.y, r.bucket] = r.n
    return counts


def calibration(score: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve from scores to labels, with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - good) * score).sum() + 0.1 * (a - 1), (p - good).sum() + 0.1 * b])
        curve = np.array([[(w * score * score).sum() + 0.1, (w * score).sum()], [(w * score).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(curve, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -5, 5)
    return max(float(a), 0.0), float(b)


def _labels(labels: DataFrame, key: str, label: str, most: int) -> dict:
    """At most about ``most`` labels by a hash of the key; keys with contradicting labels are left out."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    chosen = one.select("key", "y").orderBy(F.xxhash64(F.col("key")), "key").limit(most)
    return {r.key: int(r.y) for r in chosen.collect()}


def classify(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("lang", "source"), label: str = "quality",
    rounds: int = 2, confidence: float = 0.99, most_labels: int = 20_000, keep_good: float = 0.995,
) -> DataFrame:
    """Per row: key, ``p_text``, ``p_meta``, ``probability`` that it is good, and ``kept``.

    ``kept`` is false below the lesser of 0.5 and the score that ``keep_good`` of the held-out good documents reach. Null texts are
    scored as empty ones, null metadata as a value of its own; null keys are scored and never labelled. Without labels of both
    kinds every probability is the prior (0.5 without any) and every row is kept. Equal rows get equal results.
    """
    spark = df.sparkSession
    known = _labels(labels, key, label, most_labels)
    held_out = {k for k in known if xxhash.xxh3_64_intdigest(str(k)) % 5 == 0}
    train = {k: y for k, y in known.items() if k not in held_out}
    names = [f"meta{i}" for i in range(len(metadata))]
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *(F.col(c).cast("string").alias(n) for c, n in zip(metadata, names, strict=True)))
    bad, good = (sum(y == k for y in train.values()) for k in (0, 1))
    prior = float(np.log((good + 1) / (bad + 1)))
    if not bad or not good:
        views, curves, least = Views(np.zeros(BUCKETS), np.zeros(META), prior), ((1.0, 0.0), (1.0, 0.0)), 0.0
    else:
        shared, held = (spark.sparkContext.broadcast(x) for x in (train, held_out))
        limit, views = float(np.log(confidence / (1 - confidence))), None
        for _ in range(rounds + 1):
            views = Views.fitted(_counted(docs, names, shared, held, views, limit), prior)
        rows = _scores(docs.where(F.col("key").isNotNull()), names, views, held).collect()
        curves, least = ((1.0, 0.0), (1.0, 0.0)), 0.0
        if rows:
            y = np.array([known[r.key] for r in rows])
            scores = [np.array([r[c] for r in rows]) for c in ("text", "meta")]
            curves = tuple(calibration(s, y) for s in scores)
            total = sum(a * s + b for (a, b), s in zip(curves, scores, strict=True)) - prior
            reached = 1 / (1 + np.exp(-np.clip(total[y == 1], -700, 700)))
            least = min(0.5, float(np.quantile(reached, 1 - keep_good))) if len(reached) else 0.0
    all_scores = _scores(docs, names, views, None)
    (a, b), (c, d) = curves
    view_text, view_meta = a * F.col("text") + b, c * F.col("meta") + d
    chance = lambda x: 1 / (1 + F.exp(-x))
    whole = all_scores.select(F.col("key").alias(key), chance(view_text).alias("p_text"), chance(view_meta).alias("p_meta"), chance(view_text + view_meta - prior).alias("probability"))
    return whole.withColumn("kept", F.col("probability") >= least)


def _scores(docs: DataFrame, names: list[str], views: Views, only) -> DataFrame:
    """key, text and meta scores of all documents, or of those in the broadcast set ``only``."""
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array([k in only.value for k in batch.column("key").to_pylist()], pa.bool_()))
            for begin, end in slices(batch, "text", 1 << 20):
                part = batch.slice(begin, end - begin)
                both = scored(shared.value, part.column("text").to_pylist(), [part.column(c).to_pylist() for c in names])
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x) for x in both)], ["key", "text", "meta"])

    schema = T.StructType([docs.schema["key"], T.StructField("text", T.DoubleType()), T.StructField("meta", T.DoubleType())])
    return docs.mapInArrow(run, schema)
