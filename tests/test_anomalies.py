import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lucarne.operators import forest
from lucarne.operators.anomalies import detect_anomalies, iqr_screen, row_severity
from lucarne.operators.profile import numeric_histogram


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"key": range(400), "a": rng.normal(50, 5, 400), "b": rng.exponential(3, 400), "c": 4.0})
    pdf.loc[3, "a"], pdf.loc[9, "b"] = 500.0, 90.0
    pdf.loc[[20, 21], "a"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).withColumn("text", F.lit("t")).cache()


def test_zscore_against_numpy(table, data):
    x = data[["a", "b", "c"]].fillna(data[["a", "b", "c"]].median())
    with np.errstate(invalid="ignore"):
        z = np.abs((x - x.mean()) / x.std(ddof=0))
    worst = z.max(axis=1)
    want = {k: round(min(s / 5.0, 1), 4) for k, s in zip(data.key, worst) if s > 2.5}
    found = detect_anomalies(table, "zscore", "strict", ["a", "b", "c", "text"], ["key"])
    assert found.columns == ["a", "b", "c"]
    got = {r.key: r.score for r in found.anomalies.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in got)
    first = found.ordered(["key"]).first()
    assert first.key in (3, 9) and first.severity == "high" and first.contributing_columns[0] in ("a", "b")


def test_iqr_against_pandas(table, data):
    x = data[["a", "b", "c"]]
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    width = q3 - q1
    flag = ((x < q1 - 2 * width) | (x > q3 + 2 * width)).any(axis=1)
    dev = ((x - x.median()) / width.replace(0, 1)).abs().max(axis=1)
    want = {k: min(d / 6, 1) for k, d, f in zip(data.key, dev, flag) if f}
    found = detect_anomalies(table, "iqr", "standard", ["a", "b", "c"], ["key"])
    got = {r.key: r for r in found.anomalies.collect()}
    assert got.keys() == want.keys() and all(got[k].score == pytest.approx(want[k], abs=1e-4) for k in got)
    row = got[3]
    assert row.contributing_columns[0] == "a" and row["values"].text == "t" and row.score_label.startswith("×")
    assert row.normal_ranges["a"].median == pytest.approx(x["a"].median())
    s = found.summary().first()
    assert (s.total_rows, s.anomaly_count, s.high + s.moderate + s.low) == (400, len(want), len(want))
    assert s.top_columns[0] in ("a", "b")


def test_nothing_numeric(rows):
    found = detect_anomalies(rows([("x",)], "t string"), "iqr")
    assert found.anomalies.count() == 0
    s = found.summary().first()
    assert (s.total_rows, s.anomaly_count, s.severity, s.top_columns) == (1, 0, "low", [])


def test_labels(rows):
    df = rows([(i, v) for i, v in enumerate([0.0] * 20 + [5.0])], "key int, v double")
    assert detect_anomalies(df, "iqr", "strict", ["v"], ["key"]).anomalies.first().score_label == "Valeur atypique sur v"
    near = rows([(i, v) for i, v in enumerate([100.0] * 20 + [101.0] * 10 + [130.0])], "key int, v double")
    assert detect_anomalies(near, "iqr", "strict", ["v"], ["key"]).anomalies.first().score_label == "30% d'écart à la médiane"


def test_severity(rows):
    df = rows([(0.75,), (0.7499,), (0.45,), (0.1,)], "s double")
    assert [r[0] for r in df.select(row_severity(F.col("s"))).collect()] == ["high", "moderate", "moderate", "low"]


def test_screen(spark):
    df = spark.range(100).select(F.when(F.col("id") < 97, F.col("id") * 1.0).otherwise(F.col("id") * 100.0).alias("weight"), F.lit(1).alias("k"))
    assert [tuple(r) for r in iqr_screen(df).collect()] == [("weight", "continuous", 3, 3.0, "medium")]


def test_tree_nodes_cover_their_points():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(64, 2))
    nodes = forest.grow_tree(points, rng, 6)
    numbers = {n for n, *_ in nodes}
    assert all(((n - 1) // 2) in numbers for n in numbers if n)
    assert forest.grow_tree(np.ones((8, 2)), rng, 3) == [(0, -1, 0.0, pytest.approx(float(forest.expected_path(8))))]


def test_expected_path():
    assert [float(v) for v in forest.expected_path(np.array([0, 1, 2]))] == [0.0, 0.0, 1.0]
    assert float(forest.expected_path(256)) == pytest.approx(10.2448, abs=1e-4)


def test_forest_finds_the_planted_rows(table):
    found = detect_anomalies(table, "isolation_forest", "strict", ["a", "b"], ["key"])
    rows = {r.key: r for r in found.anomalies.collect()}
    assert len(rows) == pytest.approx(0.05 * 400, abs=1)
    assert {3, 9} <= rows.keys()
    assert max(r.score for r in rows.values()) == 1.0
    assert "_raw" not in found.anomalies.select("values.*").columns


def test_forest_with_a_third_of_the_rows_alike(spark):
    df = spark.range(3000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(3)).alias("a"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(4)).alias("b"),
    ).cache()
    found = detect_anomalies(df, "isolation_forest", "standard", ["a", "b"], ["key"])
    assert found.anomalies.filter("key % 3 = 0").count() == 0     # the crowd is never the anomaly
    assert 200 < found.anomalies.count() <= 300


def test_forest_on_constant_columns(rows):
    df = rows([(i, 1.0) for i in range(20)], "key int, a double")
    assert detect_anomalies(df, "isolation_forest", "loose", ["a"], ["key"]).anomalies.count() == 0


def test_fences_reach_the_reader(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for method in ("iqr", "zscore"):
        found = detect_anomalies(events, method, "standard", ["value", "user_id"], ["event_id"]).anomalies
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [Or(" in plan, plan


def test_nan_is_never_beyond_a_fence(rows):
    df = rows([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 2.0, 1.0, float("nan"), None, 90.0])], "key int, v double")
    for method in ("iqr", "zscore"):
        assert {r.key for r in detect_anomalies(df, method, "strict", ["v"], ["key"]).anomalies.collect()} == {7}


def test_numbers_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, float(i % 50), float(i % 40)) for i in range(1000)] + [(1000, inf, 500.0), (1001, nan, 3.0), (1002, -inf, 3.0)]
    df = spark.createDataFrame(rows, "key int, size_a double, size_b double")
    found = detect_anomalies(df, "zscore", "strict", ["size_a", "size_b"], ["key"])
    assert [r.key for r in found.anomalies.collect()] == [1000]
    assert sorted(r.key for r in detect_anomalies(df, "iqr", "strict", ["size_a"], ["key"]).anomalies.collect()) == [1000, 1002]
    assert {r["column"]: r["count"] for r in iqr_screen(df).collect()} == {"size_a": 2, "size_b": 1}
    with pytest.raises(ValueError, match="size_a"):
        detect_anomalies(df, "isolation_forest", "standard", ["size_a"], ["key"])
    bins = [r for r in numeric_histogram(df, ["size_a"], bins=3).collect()]
    assert sorted((r.bin, r["count"]) for r in bins) == [(0, 341), (1, 320), (2, 341)]


def test_forest_does_not_depend_on_the_layout(spark):
    df = spark.range(8000).select("id", F.randn(3).alias("a"), F.rand(4).alias("b")).cache()
    want = None
    for parts in (1, 3, 8):
        found = detect_anomalies(df.repartition(parts), "isolation_forest", "standard", ["a", "b"], ["id"])
        got = sorted((r.id, r.score) for r in found.anomalies.collect())
        want = want or got
        assert got == want and got


def test_forest_sees_equal_rows_in_a_large_table(spark):
    df = spark.range(300000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(3)).alias("a"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(4)).alias("b"),
    )
    found = detect_anomalies(df, "isolation_forest", "standard", ["a", "b"], ["a"])
    assert found.anomalies.filter("a = 5").count() == 0     # rows without a key: a third of them are one point
    assert 20000 < found.anomalies.count() <= 30000


def test_forest_draws_copies_by_their_share(spark):
    held = spark.range(400000).select(F.when(F.col("id") % 4 == 0, 5.0).otherwise(F.rand(3)).alias("a"))
    grown = forest.fit(held, ["a"], 400000, trees=50)
    at = grown.scores(np.array([[5.0]]))[0]
    # 64 of a tree's 256 rows lie beyond its first splits.
    few = forest.fit(held.filter("a <> 5"), ["a"], 300000, trees=50).scores(np.array([[5.0]]))[0]
    assert at > few + 0.05
