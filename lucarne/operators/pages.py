"""Any page of a sorted table by its position (FLT-8), from a directory of sorted ranges.

The table is split by range of its sort columns and key, sorted inside each range and written once, each row with its place in
its range. The counts of the ranges, added up, tell which ranges hold a page, and only those are read. An offset gathers all
rows before the page; here the cost of a page does not depend on its number.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.operators.filters import ordering
from lucarne.session import staging_root


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class SortedPages:
    """Pages of ``df`` in the order of ``by`` (names or ``(name, ascending)``) and then of ``key``.

    The key should tell rows apart: rows equal in all of these columns come in any order, but each in one place only. It also
    lets a sort value that holds a third of the rows fall into many ranges. The driver keeps one count per range.
    """

    def __init__(self, df: DataFrame, by: Sequence[str | tuple[str, bool]], key: Sequence[str]):
        spark, terms = df.sparkSession, ordering(by, key)
        self.columns = [f"`{c}`" for c in df.columns]
        self.range, self.place = _unused(df, "range"), _unused(df, "place")
        # The low 33 bits of the id are the row's number in its task.
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        rows = df.repartitionByRange(*terms).sortWithinPartitions(*terms)
        rows = rows.select("*", place.alias(self.place), F.spark_partition_id().alias(self.range))
        self.path = f"{staging_root(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
        rows.write.partitionBy(self.range).parquet(self.path)
        self.rows = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])).parquet(self.path)
        counts = sorted(tuple(r) for r in self.rows.groupBy(self.range).count().collect())
        self.ranges = [r for r, _ in counts]
        self.starts = [0, *accumulate(n for _, n in counts)]

    @property
    def total(self) -> int:
        """Rows of the table."""
        return self.starts[-1]

    def page(self, number: int, size: int = 15) -> DataFrame:
        """Page ``number`` (from 0), in order; pages beyond the last are empty."""
        if number < 0 or size < 1:
            raise ValueError("page numbers start at 0 and a page has at least one row")
        first, end = number * size, (number + 1) * size
        held = F.lit(False)
        for r, start, stop in zip(self.ranges, self.starts, self.starts[1:], strict=False):
            if start < end and first < stop:
                held |= (F.col(self.range) == r) & F.col(self.place).between(first - start, end - start - 1)
        return self.rows.filter(held).orderBy(self.range, self.place).select(*self.columns)

    def drop(self) -> None:
        """Remove the sorted copy; its pages can be read no more."""
        spark = self.rows.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
