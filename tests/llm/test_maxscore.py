"""Search beside scoring every document."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lucarne.llm import maxscore
from lucarne.llm.maxscore import Index, Postings, gains, shard_rows
from lucarne.llm.queries import op12_maxscore


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    rows = [(key, Counter(words(t))) for key, t in docs if key is not None and words(t)]
    count, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    asked = {}
    for key, t in items:
        if key is not None:
            asked.setdefault(key, Counter()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for key, c in rows:
            m = 100 - 25 + (25 * sum(c.values()) * count) // length
            score = sum(
                often * math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, often in terms.items() if w in c
            )
            if score > 0:
                found.append((-score, key))
        out += [(item, i + 1, key, -s) for i, (s, key) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "postings", "asked"), [(0, 400, 9), (1, 10**6, 10**6), (2, 2500, 10**6)])
def test_against_all_documents(spark, monkeypatch, seed, postings, asked):
    monkeypatch.setattr(maxscore, "BLOCK", 4)
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 4))) for _ in range(150)]
    texts = [" ".join(pick.choice(vocabulary[: pick.choice([5, 40, 150])]) for _ in range(pick.choice([1, 5, 30, 120]))) for _ in range(260)]
    docs = [(i, t.upper() if i % 9 == 0 else t) for i, t in enumerate(texts + texts[:40])]
    items = [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([1, 3, 12])))) for i in range(25)]
    index = Index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), postings=postings)
    got = index.search(spark.createDataFrame(items, "item_id long, text string"), k=6, asked=asked)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, 6)


@pytest.mark.parametrize("window", [1, 7, 64, 4096])
def test_windows_and_skipping(monkeypatch, window):
    """One shard, many windows: the same results, and blocks that no candidate needs stay shut."""
    monkeypatch.setattr(maxscore, "BLOCK", 4)
    pick = random.Random(4)
    n = 1500
    part = np.array([75 + pick.randint(1, 200) for _ in range(n)])
    rows = [(t, d, pick.choice([1, 1, 2, 300, 70000])) for t, often in enumerate([900, 700, 40, 12]) for d in sorted(pick.sample(range(n), often))]
    term, doc, tf = (np.array(x) for x in zip(*rows, strict=True))
    order = np.lexsort((term, doc))
    names = [b"a", b"b", b"c", b"d"]
    batch = shard_rows(3, np.arange(n)[::-1].copy(), part, names, term[order], doc[order], tf[order])
    shard = maxscore.Shard(pa.Table.from_batches([batch]))
    weights = [1, 2, 900, 4000]
    score = np.zeros(n, dtype=np.int64)
    for t, d, f in rows:
        score[d] += weights[t] * gains(np.array(f), part[d])
    want = sorted((-s, n - 1 - d) for d, s in enumerate(score.tolist()) if s)[:5]
    keys, scores = shard.search(names, weights, 5, window)
    assert list(zip((-scores).tolist(), keys.tolist(), strict=True)) == want
    if window == 7:
        lists: dict[bytes, Postings] = shard.lists
        assert len(lists[b"a"].open) < len(lists[b"a"].last) / 2


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t,;"), (None, "a b"), (4, "a"), (5, "a a a b"), (6, "b " * 50000), (7, "z"), (5, "a a a b"), (8, "É é\x00x"), (9, "a-b_c9"), (10, "q")]
    items = [(4, "A"), (4, "b"), (9, "nothing here"), (None, "a"), (11, None), (12, "é É x"), (13, "a a a c9"), (14, ""), (15, "q z")]
    d, q = (spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{key} long, text string, rank int, shard int, score int") for key, rows in (("doc_id", docs), ("item_id", items)))
    assert sorted(tuple(r) for r in Index(d).search(q, k=3).collect()) == brute(docs, items, 3)
    assert Index(d.limit(0)).search(q).count() == 0 and Index(d).search(q.limit(0)).count() == 0
    got = Index(d).search(q.withColumnRenamed("item_id", "doc"), key="doc", k=1)
    assert got.columns == ["doc", "rank", "doc_id", "score"]


def test_query(spark, tables):
    docs, items = [(i, f"w{i % 7} w{i % 11} common W{i % 5}") for i in range(90)], [(i, f"w{i} common") for i in range(6)]
    folder = tables(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in op12_maxscore(spark, folder).collect()) == brute(docs, items, 20)


def test_a_task_holds_a_bounded_number_of_postings(monkeypatch):
    """Building takes as much memory for three times as many postings, and the shards hold every one of them."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(maxscore, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 1)}))
    text = [" ".join(map(str, rng.choice(60_000, 1000, replace=False))).encode() for _ in range(20)]

    def peak(batches):
        texts = ({"key": range(20 * i, 20 * i + 20), "text": text} for i in range(batches))
        tracemalloc.start()
        try:
            rows = [sum(b.column("docs")[1:].to_pylist()) for b in maxscore._indexed((pa.RecordBatch.from_pydict(t) for t in texts), 1, 1, maxscore.POSTINGS)]
            return tracemalloc.get_traced_memory()[1], sum(rows)
        finally:
            tracemalloc.stop()

    (small, few), (large, many) = peak(55), peak(165)
    assert (few, many) == (55 * 20_000, 165 * 20_000)
    assert large < 1.2 * small and large < 150e6
