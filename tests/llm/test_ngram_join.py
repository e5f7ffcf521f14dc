"""The join beside brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from lucarne.llm import ngram_join
from lucarne.llm.ngram_join import Words, bands, class_ids, linked_components, most_differences, shingle_sets, signatures
from lucarne.llm.shared import Staging
from tests.llm.test_components import plain


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=4, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    root = plain(edges)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root.get(i, i)
        least[r] = min([k for k in (least.get(r), key) if k is not None], default=None)
    return sorted(((key, len(sets[i]), least[root.get(i, i)]) for i, (key, _) in enumerate(rows)), key=repr)


def corpus(seed, size=160):
    """Texts with copies, edited copies at all distances, a common passage, and short ones."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 5)))
    passage, rows, bases = [word() for _ in range(15)], [], []
    for i in range(size):
        kind = pick.random()
        if kind < 0.45 and bases:
            words = list(pick.choice(bases))
            for _ in range(pick.randint(0, max(1, len(words) // 25))):
                at = pick.randrange(len(words))
                words[at:at + pick.randint(0, 2)] = [word()]
        elif kind < 0.7:
            words = [*passage, *(word() for _ in range(pick.randint(0, 8)))]
        else:
            words = [word() for _ in range(pick.choice([0, 1, 2, 3, 4, 5, 8, 20, 60, 200, 400]))]
        bases.append(words or ["x"])
        rows.append((i * 3, pick.choice([" ", "\n", "\t "]).join(w.upper() if pick.random() < 0.1 else w for w in words)))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, class int, size string")
    got = linked_components(df, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_random_corpus_in_small_blocks(spark, monkeypatch):
    """Blocks of two rows take every path of the block pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "SMALL", 0)
    rows = corpus(1)
    assert found(spark, rows) == brute(rows)


def test_small_tables_in_few_files(spark, monkeypatch):
    """With many shuffle partitions, small tables are not written in a file of each."""
    written, write = [], Staging.write

    def counted(self, df):
        out = write(self, df)
        written.append(len(out[0].inputFiles()))
        return out

    monkeypatch.setattr(Staging, "write", counted)
    rows = corpus(3)
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        assert found(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Pairs of blocks are as many as they are; nothing else of this corpus fills a file.
    assert sorted(written)[-2] <= 4 and sum(written) <= 2 * len(written) + 40


def test_other_threshold(spark):
    rows = corpus(3, 120)
    assert found(spark, rows, words=2, percent=60) == brute(rows, 2, 60)


def test_odd_rows(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [
        (5, same), (None, same.upper()), (9, same), (9, same), (1, None), (2, ""), (3, " \t\n"), (None, None), (None, "alone here"),
        (20, "a"), (21, "A"), (22, "a a a a a a a"), (23, "a a a a"), (24, "É"), (25, "é"), (26, "a b c"), (30, "w " * 30000), (31, "W " * 29999 + "v"),
        (40, " ".join(map(str, range(30000)))), (41, " ".join(map(str, range(100, 30000)))), (None, "p q r"), (None, "p q r"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_a_signature(percent):
    """Pairs at the threshold, of all sizes: no link is missed."""
    pick = random.Random(percent)
    for _ in range(400):
        a = pick.choice([6, 7, 9, 13, 20, 47, 111, 300, 1500])
        b = pick.randint(a, 100 * a // percent)
        inter = -(-percent * (a + b) // (100 + percent))
        pool = np.array([pick.getrandbits(64) for _ in range(a + b - inter)], dtype=np.uint64)
        sets = [np.sort(pool[:a]), np.sort(pool[a - inter:])]
        counts = np.array([len(s) for s in sets])
        ids = class_ids(np.concatenate(sets), counts)
        sig, who = signatures(np.concatenate(sets), counts, percent)
        assert ids[0] == ids[1] or set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()), (a, b)


def test_bands_cover_linked_sizes():
    edges = bands(85, 10**6).tolist()
    assert all(100 * (high - 1) // 85 < after for high, after in zip(edges[1:], edges[2:], strict=False))
    assert most_differences(100, 100, 85) == 16


def test_sets_and_sketch_bound():
    words = Words()
    texts = [t.encode() for _, t in corpus(8, 80)]
    sets, counts = shingle_sets(texts, 4, words)
    assert counts.tolist() == [len(shingles(t.decode(), 4)) for t in texts]
    ends, rows = np.cumsum(counts), ngram_join.sketches(sets, counts)
    for i in range(0, 80, 7):
        for j in range(80):
            a, b = (set(sets[ends[x] - counts[x]:ends[x]].tolist()) for x in (i, j))
            apart = np.abs(np.frombuffer(rows[i], np.uint8).astype(int) - np.frombuffer(rows[j], np.uint8)).sum()
            assert apart <= len(a ^ b)


def test_words_are_hashed_without_a_table():
    words = Words()
    got = words([b"one", b"two", b"one"]).tolist()
    assert got == [ngram_join.xxhash.xxh3_64_intdigest(w) for w in (b"one", b"two", b"one")]
    assert not vars(words)
