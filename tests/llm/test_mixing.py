"""Targets beside plain resharing, tilts beside bisection, and rounding."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lucarne.llm import mixing
from lucarne.llm.mixing import mix, repeated, shared_targets, word_count
from lucarne.llm.queries import op7_mixing


def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and target[s] >= most * sizes[s]}
        if not over:
            return target
        full |= over


def plain_rates(sizes, target, most):
    """Rates of one source by bisection over the tilt."""
    low, high = -1e3, 1e3
    for _ in range(300):
        mid = (low + high) / 2
        rates = [most / (1 + math.exp(min(700, max(-700, -mid * n)))) for n in sizes]
        low, high = (low, mid) if sum(n * r for n, r in zip(sizes, rates, strict=True)) > target else (mid, high)
    return rates


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(2)
    rows = []
    for i in range(3000):
        source = pick.choice([*["big"] * 8, "a", "b", "é", "Z", None, "tiny"]) if i else "tiny"
        size = 40 if pick.random() < 0.3 else int(math.exp(pick.gauss(4, 1.5)))
        rows.append((i, source, 3 if source == "tiny" else size))
    return rows


@pytest.mark.parametrize("bucket", [4096, 50])
def test_mix(spark, corpus, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    df = spark.createDataFrame([(*r, "old", [1, 2]) for r in corpus], "doc_id long, source string, words long, target string, src array<int>")
    got = mix(df, F.col("words"))
    assert got.columns == ["doc_id", "source", "words", "src", "size", "source_size", "target", "rate", "copies", "taken"]
    rows = got.collect()
    assert len(rows) == len(corpus)
    sizes, by = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.source] += r.words
        by[r.source].append(r)
        assert r.size == r.words and r.taken == r.copies * r.size and 0 <= r.copies <= 2
    target = plain_targets(sizes, [3, 1, 2], 1.5, 2)
    for source, own in by.items():
        assert {r.source_size for r in own} == {sizes[source]}
        assert all(math.isclose(r.target, target[source], rel_tol=1e-12) for r in own)
        assert abs(sum(r.taken for r in own) - target[source]) <= max(r.size for r in own) + 1e-6 * target[source]
        want = plain_rates([r.size for r in own], target[source], 2)
        if target[source] < 2 * sizes[source]:
            assert all(math.isclose(r.rate, w, rel_tol=1e-4, abs_tol=1e-6) for r, w in zip(own, want, strict=True))
    again = {r.doc_id: r.taken for r in mix(df.repartition(7), F.col("words")).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_targets(spark):
    pick = random.Random(9)
    for _ in range(3):
        sizes = {s: pick.choice([0, 1, 10, 1000, pick.randrange(10**6)]) for s in [None, *"abcdefgh"]}
        got = shared_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [3.0, 1.0, 2.0], 1.5, 2.0).collect()
        want = plain_targets(sizes, [3, 1, 2], 1.5, 2)
        assert {r.source: r.target for r in got} == pytest.approx(want)


def test_odd_rows(spark, tables):
    texts = [(1, None, "x"), (2, "", "x"), (None, "one two", "x"), (3, "\t\n", None), (4, "a b c", None), (4, "a b c", None), (4, "a b c", None), (5, "w " * 50000, "x"), (None, "one two", "x"), (6, None, "empty")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = op7_mixing(spark, tables(documents=docs)).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 0, 0, 2, 2, 3, 3, 3, 50000]
    assert {(r.source_size, r.target) for r in rows if r["size"] == 0} == {(50004, 75001.5), (9, 18.0), (0, 0.0)}
    assert op7_mixing(spark, tables(documents=docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        mix(docs, F.lit(1), weights=(1.0, 0.0))


def test_copies_and_words(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 2, "c")], "k int, copies long, time string")
    assert sorted((r.k, r.time) for r in repeated(df).collect()) == [(2, "b"), (3, "c"), (3, "c")]
    texts = spark.createDataFrame([(None,), ("",), (" a\x0bb\tc d\n",)], "t string")
    assert [r[0] for r in texts.select(word_count(F.col("t"))).collect()] == [0, 0, 3]
