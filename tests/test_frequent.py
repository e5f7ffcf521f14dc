"""Frequent values beside counting every value."""

import random
from collections import Counter

import pytest

from lucarne.operators import charts, frequent, profile
from lucarne.operators.frequent import top_counts


def plain(values, limit):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:limit]


def found(df, column, limit):
    rows = [r for r in top_counts(df, df.columns, limit).collect() if r.column == column]
    return sorted(((r.value, r["count"]) for r in rows), key=lambda x: (-x[1], x[0].encode())), {r.cells for r in rows}


@pytest.mark.parametrize("tracked", [4096, 64, 16])
@pytest.mark.parametrize("buckets", [1 << 16, 3])
def test_against_plain_counts(spark, monkeypatch, tracked, buckets):
    monkeypatch.setattr(frequent, "TRACKED", tracked)
    monkeypatch.setattr(frequent, "BUCKETS", buckets)
    pick = random.Random(tracked + buckets)
    long = ["x" * 300 + str(i) for i in range(5)]
    columns = {
        "few": [pick.choice(["a", "b", "é", None]) for _ in range(3000)],
        "tail": ["hot" if i % 3 == 0 else f"v{int(pick.paretovariate(0.7))}" for i in range(3000)],
        "unique": [f"u{i}" for i in range(3000)],
        "long": [pick.choice(long) if i % 2 else f"y{i}" for i in range(3000)],
        "none": [None] * 3000,
    }
    schema = ", ".join(f"{c} string" for c in columns)
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema).repartition(3)
    for c, values in columns.items():
        got, cells = found(df, c, 7)
        assert got == plain(values, 7)
        assert not got or cells == {sum(v is not None for v in values)}


def test_ties_at_the_last_place_are_settled_by_value(spark, monkeypatch):
    monkeypatch.setattr(frequent, "TRACKED", 16)
    values = ["top"] * 50 + [f"t{i:04d}" for i in range(900) for _ in range(2)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    assert found(df, "v", 5)[0] == plain(values, 5)


def test_empty_and_odd_names(spark):
    df = spark.createDataFrame([], "`a.b` string")
    assert top_counts(df, ["a.b"], 3).count() == 0 and top_counts(df, [], 3).count() == 0
    one = spark.createDataFrame([("x",), (None,)], "`a.b` string")
    assert [tuple(r) for r in top_counts(one, ["a.b"], 3).collect()] == [("a.b", "x", 1, 1)]
    assert [tuple(r) for r in profile.frequent_values(one, ["a.b"]).collect()] == [("a.b", 1, "x", 1, 100.0)]


def test_frequency_chart(spark, monkeypatch):
    monkeypatch.setattr(frequent, "TRACKED", 16)
    df = spark.createDataFrame([(i % 7 if i % 2 else i,) for i in range(400)], "n int")
    want = sorted(Counter(str(i % 7 if i % 2 else i) for i in range(400)).items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in charts.frequency(df, "n", limit=9).collect()] == want[:9]
    assert [tuple(r) for r in charts.frequency(df, "n").collect()] == want
