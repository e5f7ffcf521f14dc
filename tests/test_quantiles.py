import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucarne.operators.quantiles import LINEAR, NEAREST, approximate_quantiles, column_quantiles, group_quantiles, typed_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def expected(values, q, kind):
    a = np.sort(np.asarray(values, dtype=float))
    if kind == LINEAR:
        return float(np.quantile(a, q))
    return float(a[min(len(a) - 1, math.floor((len(a) - 1) * q + 0.5))])


def cases():
    r = random.Random(3)
    return {
        "one": [4.0],
        "two": [1.0, 2.0],
        "tied": [7.0] * 50,
        "uniform": [r.random() for _ in range(5000)],
        "third_same": [3.0] * 2000 + [r.gauss(3, 1) for _ in range(4000)],
        "two_heavy": [1.0] * 3000 + [2.0] * 3000 + [1 + r.random() for _ in range(40)],
        "wide": [math.copysign(10 ** r.uniform(-200, 200), r.random() - 0.5) for _ in range(3000)],
        "negative": [-float(i % 97) for i in range(3000)],
    }


@pytest.fixture(scope="module")
def long(spark):
    data = [(g, v) for g, values in cases().items() for v in values]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "column string, value double").repartition(7).cache()


@pytest.mark.parametrize("kind", [NEAREST, LINEAR])
@pytest.mark.parametrize("sketch,small_rows,group_rows", [(4000, 100_000, 1_000_000), (4000, 100, 500), (500, 100, 100), (60, 10, 20)])
def test_exact_whatever_the_sketch(long, kind, sketch, small_rows, group_rows):
    """Coarse sketches and tiny brackets force the narrowing rounds; the answer stays exact."""
    found = group_quantiles(long, "column", "value", PROBS, kind, sketch=sketch, small_rows=small_rows, group_rows=group_rows)
    for group, values in cases().items():
        n, got = found[group]
        assert n == len(values)
        assert got == pytest.approx([expected(values, q, kind) for q in PROBS], rel=1e-12), group


@pytest.mark.parametrize("sketch,small_rows,group_rows", [(4000, 100_000, 1_000_000), (500, 100, 100), (60, 10, 20)])
def test_columns_at_once(spark, sketch, small_rows, group_rows):
    columns = {g: v for g, v in cases().items() if len(v) > 10}
    longest = max(len(v) for v in columns.values())
    data = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(longest)]
    df = spark.createDataFrame(data, ", ".join(f"{g} double" for g in columns)).repartition(7)
    for kind in (NEAREST, LINEAR):
        found = column_quantiles(df, list(columns), PROBS, kind, sketch=sketch, small_rows=small_rows, group_rows=group_rows)
        for g, values in columns.items():
            assert found[g][0] == len(values)
            assert found[g][1] == pytest.approx([expected(values, q, kind) for q in PROBS], rel=1e-12), g


def test_nearest_is_the_element_itself(spark):
    for n in (1, 2, 3, 4, 5, 6, 7, 99, 100, 101):
        df = spark.range(n).select(F.col("id").cast("double").alias("x"))
        _, (q1, q3) = column_quantiles(df, ["x"], [0.25, 0.75])["x"]
        assert (q1, q3) == (math.floor((n - 1) * 0.25 + 0.5), math.floor((n - 1) * 0.75 + 0.5))


def test_nulls_and_nan_are_left_out(rows):
    df = rows([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double")
    found = column_quantiles(df, ["a", "b"], [0.5], LINEAR)
    assert found == {"a": (2, [2.0])}


def test_infinities_are_values(rows):
    df = rows([(float("inf"),), (float("-inf"),), (0.0,)], "a double")
    assert column_quantiles(df, ["a"], [0.0, 0.5, 1.0])["a"][1] == [-math.inf, 0.0, math.inf]


@pytest.mark.parametrize("sketch,small_rows,group_rows", [(4000, 100_000, 1_000_000), (500, 100, 100), (60, 10, 20)])
def test_typed_elements(spark, sketch, small_rows, group_rows):
    r = random.Random(8)
    keys = [2**60 + r.randint(0, 5000) for _ in range(3000)] + [-(2**63), 2**63 - 1, None]
    days = [dt.date(1950, 1, 1) + dt.timedelta(days=r.randint(0, 40_000)) for _ in keys]
    moments = [dt.datetime(1960, 1, 1) + dt.timedelta(microseconds=r.randint(0, 10**16)) for _ in keys]
    prices = [Decimal(r.randint(-(10**17), 10**17)).scaleb(-3) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, days, moments, prices, strict=True)), "key long, day date, moment timestamp_ntz, price decimal(18,3)").repartition(5)
    found = typed_quantiles(df, df.columns, PROBS, sketch=sketch, small_rows=small_rows, group_rows=group_rows)
    for c, values in (("key", keys), ("day", days), ("moment", moments), ("price", prices)):
        a = sorted(v for v in values if v is not None)
        assert found[c] == (len(a), [a[min(len(a) - 1, math.floor((len(a) - 1) * q + 0.5))] for q in PROBS]), c


def test_types_without_whole_order_are_refused(spark):
    df = spark.createDataFrame([("a", Decimal(1))], "t string, d decimal(30,2)")
    for c in df.columns:
        with pytest.raises(ValueError, match="is string|30 digits"):
            typed_quantiles(df, [c], [0.5])
    assert typed_quantiles(df.limit(0).withColumn("n", F.lit(1)), ["n"], [0.5]) == {}


def test_approximate_within_its_error(spark):
    n = 50_000
    df = spark.range(n).select((F.col("id") * 3 + 2**60).alias("key"), F.sqrt("id").alias("x"), F.lit(None).cast("int").alias("none"))
    found, error = approximate_quantiles(df, df.columns, PROBS, sketch=200)
    assert set(found) == {"key", "x"} and 0.01 < error < 0.02
    for q, key, x in zip(PROBS, found["key"][1], found["x"][1], strict=True):
        assert abs((key - 2**60) / 3 / n - q) <= 1.5 * error and abs(x * x / n - q) <= 1.5 * error


def test_three_misses_rank_everything(spark, monkeypatch):
    from lucarne.operators import quantiles

    def missed(source, groups, real=quantiles._select):
        if all(math.isinf(b) for info in groups.values() for i in info["intervals"] for b in i[:2]):
            return real(source, groups)
        raise quantiles._Missed("always")

    monkeypatch.setattr(quantiles, "_select", missed)
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"))
    assert column_quantiles(df, ["x"], [0.5], small_rows=10)["x"] == (2000, [1000.0])
