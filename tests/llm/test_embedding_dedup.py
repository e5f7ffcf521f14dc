"""Links beside brute force: exact above the recall, and exact counts in every component."""

import math

import numpy as np
import pytest

from lucarne.llm import embedding_dedup
from lucarne.llm.embedding_dedup import near_duplicates
from tests.llm.test_components import plain

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.93):
    good = {}
    for key, vec, label, _ in rows:
        if key is not None and label is not None and vec and all(x is not None and math.isfinite(x) for x in vec) and any(vec):
            v = np.array(vec, dtype=np.float32).astype(float)
            good[key] = (label, v / np.linalg.norm(v))
    keys = list(good)
    edges = [
        (a, b) for i, a in enumerate(keys) for b in keys[:i]
        if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold
    ]
    links = {k: 0 for k, *_ in rows}
    for a, b in edges:
        links[a], links[b] = links[a] + 1, links[b] + 1
    root = plain(edges)
    return {k: (links[k], root.get(k, k)) for k in links}


def clusters(seed, groups, size, alone):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(16)
        for _ in range(size if g else 6 * size):
            rows.append((base + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3]), g % 3))
    rows += [(rng.standard_normal(16), int(rng.integers(3))) for _ in range(alone)]
    rows += [rows[0]] * 40  # a group of copies
    order = rng.permutation(len(rows))
    return [(int(k) + 1, [float(x) for x in np.float32(rows[i][0])], rows[i][1], "x") for k, i in enumerate(order)]


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = clusters(1, 12, 12, 300)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), window=16)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    want = brute(rows)
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(found[k][0] <= want[k][0] for k in want) and len(found) == len(rows)
    assert sum(found[k] == want[k] for k in want) >= 0.98 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, ""), (2, [2.0, 0.0], 0, ""), (3, [1.0, 0.0], 0, ""), (4, [1.0, 0.0], None, ""), (5, [1.0, 0.0], 1, ""), (6, None, 0, ""), (7, [], 0, ""),
        (8, [0.0, 0.0], 0, ""), (9, [1.0, None], 0, ""), (10, [nan, 1.0], 0, ""), (11, [inf, 1.0], 0, ""), (12, [1.0, -0.0], 0, ""), (13, [1.0], 0, ""), (14, [0.0, 1.0], 0, ""),
        (15, [3e38, 1e30], 0, ""), (16, [1e-38, 0.0], 0, ""),
    ]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0], 0, "")], SCHEMA)
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert {k: (r.n_links, r.component_id) for k, r in got.items() if k is not None} == brute(rows)
    assert all(r.kept == (k is not None and r.component_id == k) for k, r in got.items())
    assert (got[None].n_links, got[None].component_id) == (0, None)
    assert near_duplicates(df.limit(0)).count() == 0


def test_threshold():
    with pytest.raises(ValueError):
        near_duplicates(None, threshold=1.0)


def narrow(seed, n, pairs, cosine=0.8, size=64):
    """Vectors of one label around a common direction, ``pairs`` of them with a partner just above the threshold."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    noise = unit(rng.standard_normal((n, size - 1))) * math.sqrt(1 - cosine)
    vectors = np.hstack([np.full((n, 1), math.sqrt(cosine)), noise])
    side = rng.standard_normal((pairs, size))
    side = unit(side - (side * vectors[:pairs]).sum(axis=1, keepdims=True) * vectors[:pairs])
    vectors = np.vstack([vectors, 0.935 * vectors[:pairs] + math.sqrt(1 - 0.935**2) * side])
    order = rng.permutation(len(vectors))
    return [(k + 1, [float(x) for x in np.float32(vectors[i])], 0, "") for k, i in enumerate(order)]


@pytest.mark.parametrize("outright", [False, True])
def test_label_around_one_direction(spark, outright):
    rows = narrow(5, 2500, 250)
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    x, y = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))
    want = np.bincount(np.concatenate([x, y]), minlength=len(rows))
    # 16 of 2 750 places, as a window of 64 is among 11 000.
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), window=16, most_passes=1 << 20, exact=outright).collect()
    found = np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])
    assert (found <= want).all()
    assert found.sum() >= 0.99 * want.sum() if not outright else (found == want).all()


def test_small_labels_go_through_passes(spark, monkeypatch):
    """No label is too small for the passes: nothing is compared outright where the passes tell pairs apart."""
    monkeypatch.setattr(embedding_dedup, "_all_pairs", None)
    rows = narrow(6, 300, 40, cosine=0.2)
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), window=16).collect()}
    want = brute(rows)
    assert sum(found[k] == want[k] for k in want) >= 0.98 * len(want)


def test_one_dense_spot(spark):
    """A label that is mostly one spot, which no sign parts, keeps every link."""
    rng = np.random.default_rng(9)
    spot = rng.standard_normal(16)
    near = [spot + 0.02 * rng.standard_normal(16) for _ in range(400)] + [rng.standard_normal(16) for _ in range(50)]
    rows = [(k, [float(x) for x in np.float32(v)], 0, "") for k, v in enumerate(near)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), window=16)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute(rows)
