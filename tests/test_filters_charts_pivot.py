import pytest
from pyspark.sql import functions as F

from lucarne.operators import charts, filters
from lucarne.operators.pivot import pivot, sorted_pivot


@pytest.fixture(scope="module")
def sales(spark):
    data = [
        (1, "a", "n", 10.0, True, None), (2, "a", "s", 20.0, False, "x"), (3, "b", "n", 5.0, True, "y"), (4, "b", None, 7.5, None, "x"),
        (5, None, "n", 1.0, False, "x"), (6, "a", "n", None, True, "z"),
    ]
    return spark.createDataFrame(data, "id int, shop string, side string, price double, paid boolean, `odd.name` string").cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_equality_and_membership(sales):
    assert ids(filters.apply_filters(sales, {"shop": "a", "missing": 1})) == [1, 2, 6]
    assert ids(filters.apply_filters(sales, {"shop": ["a", "b"], "side": ["n"], "price": []})) == [1, 3, 6]
    assert ids(filters.apply_filters(sales, {"price": "20", "id": ["2", "x"]})) == [2]
    assert ids(filters.apply_filters(sales, {"id": "many"})) == []
    assert ids(filters.apply_filters(sales, {"paid": "oui"})) == [1, 3, 6]
    assert ids(filters.apply_filters(sales, {"paid": ["no"]})) == [2, 5]
    assert ids(filters.apply_filters(sales, {"odd.name": "x"})) == [2, 4, 5]
    assert ids(filters.apply_filters(sales, None)) == [1, 2, 3, 4, 5, 6]


def test_search_and_nulls(sales):
    assert ids(filters.search(sales, "X")) == [2, 4, 5]
    assert ids(filters.search(sales, "tru")) == [1, 3, 6]
    assert ids(filters.search(sales, "")) == [1, 2, 3, 4, 5, 6]
    assert ids(filters.drop_nulls(sales, ["shop", "odd.name"])) == [2, 3, 4, 6]


def test_distinct(sales, rows):
    assert [r.value for r in filters.distinct_values(sales, "shop").collect()] == ["a", "b"]
    assert filters.distinct_total(sales, "shop").first()[0] == 3
    odd = rows([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.value for r in filters.distinct_values(odd, "v").collect()] == [1.0, None, None]
    assert [r.value for r in filters.search_values(filters.distinct_values(sales, "odd.name"), "Y").collect()] == ["y"]


def test_sort_and_pages(sales):
    assert [r.id for r in filters.sort_rows(sales, ["shop", ("price", False)], ["id"]).collect()] == [5, 2, 1, 6, 4, 3]
    assert [r.id for r in filters.page(sales, [("price", False)], ["id"], 1, 2).collect()] == [4, 3]
    assert [r.id for r in filters.page_after(sales, "id", 2, 2).collect()] == [3, 4]
    assert [r.id for r in filters.page_after(sales, "id", None, 2).collect()] == [1, 2]
    assert filters.preview(sales, 2, ["id"]).first().asDict() == {"id": "1", "shop": "a", "side": "n", "price": "10.0", "paid": "true", "odd.name": None}


def test_frequency_and_sums(sales):
    assert [tuple(r) for r in charts.frequency(sales, "shop").collect()] == [("a", 3), ("b", 2)]
    assert [tuple(r) for r in charts.chart(sales, "bar", "shop", "price").collect()] == [("a", 30.0), ("b", 12.5)]
    assert [tuple(r) for r in charts.chart(sales, "pie", "shop", "side").collect()] == [("a", 3.0), ("b", 1.0)]
    assert charts.chart(sales, "bar", "shop", "price", {"shop": "none"}).count() == 0
    with pytest.raises(ValueError):
        charts.frequency(sales, "nowhere")


def test_reference_fixture_charts(spark):
    people = spark.range(20).select(
        F.concat(F.lit("Person"), "id").alias("Name"), (F.col("id") + 20).alias("Age"), (F.col("id") * 5 + 50).alias("Score")
    )
    assert charts.chart(people, "bar", "Name").count() == 20
    assert charts.chart(people, "pie", "Name", "Score").count() == 20
    table = pivot(people, ["Name"], [{"col": "Score", "agg": "sum"}])
    assert table.filter("NOT is_total").count() == 20
    assert [r.Name for r in table.filter("is_total").collect()] == ["TOTAL"]


def test_scatter(sales):
    assert [tuple(r) for r in charts.scatter(sales, "shop", "price", key=["id"], limit=2).collect()] == [("a", 10.0), ("a", 20.0)]


def test_boxplot(rows):
    df = rows([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]] + [("b", 7.0)] + [("c", None)], "g string, v double")
    boxes = {r.category: r for r in charts.boxplot(df, "g", "v").collect()}
    assert set(boxes) == {"a", "b"}
    assert tuple(boxes["a"])[1:] == (6, 1.0, 2.0, 4.0, 5.0, 5.0)
    assert tuple(boxes["b"])[1:] == (1, 7.0, 7.0, 7.0, 7.0, 7.0)
    assert [tuple(r) for r in charts.boxplot_outliers(df, "g", "v").collect()] == [("a", 1, 100.0, 1)]
    with pytest.raises(ValueError):
        charts.boxplot(df, "v", "g")


def test_outliers_of_both_ends(rows):
    usual = [("a", float(v % 10)) for v in range(1000)]
    df = rows(usual + [("a", -100.0 - i) for i in range(60)] + [("a", 100.0 + i) for i in range(60)], "g string, v double")
    got = charts.boxplot_outliers(df, "g", "v").collect()
    assert len(got) == 50 and {r.total for r in got} == {120}
    assert min(r.y for r in got) == -159.0 and max(r.y for r in got) == 159.0
    assert charts.chart(df, "boxplot", "g", "v", limit=1).count() == 1 and charts.chart(df, "bar", "v", limit=3).count() == 3


def test_search_comes_before_the_limit(spark):
    df = spark.range(3000).select(F.when(F.col("id") > 2500, F.concat(F.lit("z needle "), "id")).otherwise(F.concat(F.lit("a"), "id")).alias("v"))
    assert filters.distinct_values(df, "v", search="NEEDLE").count() == 499


def test_boxplot_keeps_the_first_categories(rows):
    df = rows([(f"{i:02d}", float(j)) for i in range(40) for j in range(3)], "g string, v double")
    assert sorted(r.category for r in charts.boxplot(df, "g", "v").collect()) == [f"{i:02d}" for i in range(30)]


def test_outliers_plan_limits_before_the_shuffle(rows):
    df = rows([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    plan = charts.boxplot_outliers(df, "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_chart_summary(sales):
    s = charts.chart_summary(charts.grouped_value(sales, "shop", "price")).first()
    assert (s["min"], s["max"], s["mean"], s["trend"]) == (12.5, 30.0, 21.0, "descendant")
    assert [(p.label, p.value) for p in s["top_values"]] == [("a", 30.0), ("b", 12.5)]


def test_pivot_nulls_names_and_totals(sales):
    table = sorted_pivot(pivot(sales, ["shop"], [("price", "sum"), ("id", "count")], ["side"]), ["shop"])
    assert table.columns == ["shop", "sum(price)_n", "sum(price)_null", "sum(price)_s", "count(id)_n", "count(id)_null", "count(id)_s", "is_total"]
    got = {r.shop: tuple(r)[1:] for r in table.collect()}
    assert got["a"] == (10.0, None, 20.0, 2, None, 1, False)
    assert got["TOTAL"] == (16.0, 7.5, 20.0, 4, 1, 1, True)
    assert [r.shop for r in table.collect()] == [None, "a", "b", "TOTAL"]


def test_group_summary_without_pivot(sales):
    table = pivot(sales, ["shop"], value_col="price", agg_func="mean", totals="displayed")
    assert table.columns == ["shop", "price", "is_total"]
    assert {r.shop: r.price for r in table.collect()} == {"a": 15.0, "b": 6.25, None: 1.0, "TOTAL": 22.25}
    again = pivot(sales, ["shop"], value_col="price", agg_func="mean", totals="recompute")
    assert {r.shop: r.price for r in again.collect()}["TOTAL"] == 8.7


def test_all_null_sum_is_zero(rows):
    df = rows([("a", None), ("b", 1.0)], "g string, v double")
    assert {r.g: r.v for r in pivot(df, ["g"], [("v", "sum")], totals=None).collect()} == {"a": 0.0, "b": 1.0}


def test_sorted_pivot_reads_numbers(rows):
    df = rows([(10, 1.0), (2, 1.0), (None, 1.0)], "k int, v double")
    assert [r.k for r in sorted_pivot(pivot(df, ["k"], [("v", "sum")]), ["k"]).collect()] == [None, "2", "10", "TOTAL"]


@pytest.mark.parametrize("arguments", [
    {"rows": [], "values": [("price", "sum")]}, {"rows": ["shop"], "values": []}, {"rows": ["shop"], "values": [("side", "sum")]},
    {"rows": ["shop"], "values": [("price", "sum"), ("price", "mean")]}, {"rows": ["shop"], "values": [("price", "sum")], "columns": ["shop"]},
    {"rows": ["nowhere"], "values": [("price", "sum")]},
])
def test_pivot_refusals(sales, arguments):
    with pytest.raises(ValueError):
        pivot(sales, **arguments)


def test_pivot_width(spark):
    df = spark.range(201).select(F.lit(1).alias("r"), "id", F.lit(1.0).alias("v"))
    with pytest.raises(ValueError, match="too many"):
        pivot(df, ["r"], [("v", "sum")], ["id"])
    assert len(pivot(df.filter("id < 200"), ["r"], [("v", "sum")], ["id"], totals=None).columns) == 202


def test_totals_reuse_the_aggregation(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    table = pivot(lines, ["l_returnflag"], [("l_extendedprice", "sum")], ["l_linestatus"])
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_pivot_keeps_null_apart_from_the_text(rows):
    df = rows([("a", None, 1.0), ("a", "null", 10.0), ("b", "x", 5.0)], "g string, pivot_key string, v double")
    got = {r.g: r for r in pivot(df, ["g"], [("v", "sum")], ["pivot_key"], totals=None).collect()}
    assert (got["a"]["null"], got["a"]["null (text)"], got["b"]["x"]) == (1.0, 10.0, 5.0)
    two = pivot(df.withColumn("w", F.lit(2)), ["g"], [("v", "sum"), ("w", "count")], ["pivot_key"], totals=None)
    assert two.columns == ["g", "sum(v)_null", "sum(v)_null (text)", "sum(v)_x", "count(w)_null", "count(w)_null (text)", "count(w)_x", "is_total"]
    with pytest.raises(ValueError):
        pivot(df, ["g"], [("v", "sum")], ["pivot_key"], max_columns=2)
    with pytest.raises(ValueError):
        pivot(df.withColumnRenamed("g", "is_total"), ["is_total"], [("v", "sum")])


def test_numbers_as_users_write_them(spark):
    numbers = [12345678.0, 0.0001, -98765432.125, 1e15, 123456789012345.6, 1e-5, 0.1, 5.0, 1e16, 1e-6, float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r.x for r in filters.preview(df, key=["i"]).collect()]
    assert got == ["12345678.0", "0.0001", "-98765432.125", "1000000000000000.0", "123456789012345.6", "0.00001", "0.1", "5.0", "1.0E16", "1.0E-6", "NaN", None]
    assert [r.i for r in filters.search(df.where("i < 5"), "12345678").sort("i").collect()] == [0, 4]
    assert filters.distinct_values(df, "x", search="98765432.1").count() == 1


def test_scatter_samples_are_the_same_on_any_layout(spark):
    df = spark.range(3000).select("id", (F.col("id") % 50).alias("a"), (F.col("id") * 7 % 31).cast("double").alias("b"))
    one = charts.scatter(df, "a", "b", key=["id"], limit=200, sample=True)
    two = charts.scatter(df.repartition(7), "a", "b", key=["id"], limit=200, sample=True)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == 200
    assert 60 < one.filter("a < 25").count() < 140
    skewed = df.unionByName(spark.createDataFrame([(-1, 1000, 500.0)], df.schema))
    cells = charts.scatter(skewed, "a", "b", key=["id"], limit=160, sample=True, grid=4).collect()
    assert (1000.0, 500.0) in {tuple(r) for r in cells} and len(cells) == 11
    assert charts.scatter(df.limit(0), "a", "b", key=["id"], sample=True, grid=3).count() == 0
    for bad in ({"key": []}, {"key": ["id"], "grid": 2}):
        with pytest.raises(ValueError, match="key|grid"):
            charts.scatter(df.withColumn("a", F.lit("t")), "a", "b", sample=True, **bad)
