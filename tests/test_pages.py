"""Pages by position beside a plain sort."""

import pytest
from pyspark.sql import functions as F

from lucarne.operators.pages import SortedPages


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables fall into several ranges too."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_every_page(spark):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 != 1, (F.col("id") * 37) % 101).alias("odd.name"), F.lit("x").alias("range"), F.lit(None).cast("string").alias("place")
    )
    pages = SortedPages(df.repartition(5), [("odd.name", False)], ["id"])
    want = sorted(df.collect(), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert pages.total == 1000 and len(pages.ranges) > 1
    for number, size in [(0, 15), (1, 15), (66, 15), (67, 15), (1, 600), (0, 2000), (999, 1), (30, 33)]:
        got = pages.page(number, size)
        assert got.columns == df.columns
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want[number * size:(number + 1) * size]]
    pages.drop()


def test_only_the_ranges_of_a_page_are_read(spark):
    pages = SortedPages(spark.range(1000).repartition(3), ["id"], ["id"])
    files = {r[0] for r in pages.page(60, 15).select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(files) <= 2


def test_equal_rows_and_no_rows(spark):
    rows = spark.range(200).select(F.lit(1).alias("a"))
    pages = SortedPages(rows, ["a"], [])
    assert sum(pages.page(n, 30).count() for n in range(8)) == 200
    empty = SortedPages(rows.limit(0), ["a"], [])
    assert empty.total == 0 and empty.page(0).count() == 0
    with pytest.raises(ValueError):
        empty.page(-1)
