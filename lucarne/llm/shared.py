"""What the operators of this package share: table access, bounded batches, staged tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucarne.session import staging_root

#: Words of the n-gram operators and of all word counts: runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if they have no other copy."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark


#: Bytes of a batch of texts for operators whose workers hold several times as much, and as much again stays with a worker between its tasks.
BATCH = 4 << 20
#: Bytes of texts taken in one go where arrays of eight bytes for every character or word are made of them.
PIECE = 1 << 18


def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> SparkSession:
    """Batches that go to Python workers are bounded by bytes as well as rows, so long texts do not pile up.

    A batch also costs its executor buffers outside the heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(most + 1))) > most:
        spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose cells come to about ``limit`` bytes (or list elements), at least one row each."""
    cells = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(cells.type) else pc.binary_length
    start, held = 0, 0
    for row, size in enumerate(pc.fill_null(length(cells), 0).to_pylist()):
        if row > start and held + size > limit:
            yield start, row
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield start, batch.num_rows


def distinct(raw: bytes, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct parts of ``raw`` between neighbouring bounds, in the order they are met, and which of them each part is."""
    if len(bounds) < 2:
        return [], np.zeros(0, np.int64)
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
    coded = cells.dictionary_encode()
    _, ends, flat = coded.dictionary.buffers()
    flat = flat.to_pybytes() if flat else b""
    ends = np.frombuffer(ends, dtype=np.int64, count=len(coded.dictionary) + 1).tolist()
    return [flat[a:b] for a, b in pairwise(ends)], coded.indices.to_numpy()


#: Bytes of rows to a file of a staged table whose number of rows is known to be small.
FILE = 4 << 20


def files(rows: int, width: int) -> int:
    """Files for at most ``rows`` rows of about ``width`` bytes."""
    return max(1, -(-rows * width // FILE))


def few(df: DataFrame, rows: int, width: int) -> DataFrame:
    """The same rows, for writing, in no more partitions than their number asks for.

    Else a table of a few rows gets a file of each shuffle partition. Each file costs its executor the opening of two files and, without
    Hadoop's native library, two processes that are started to set their permissions.
    """
    return df.coalesce(files(rows, width))


class Staging:
    """Parquet tables below ``spark.checkpoint.dir`` that cut lineage, outlive executors, and can be dropped again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = reachable(spark)
        self.root = f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)  # texts take two thirds of the disk they take otherwise
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        """Remove a staged table that no later step reads."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def spread(column: str, n: int) -> F.Column:
    """A salt in [0, n) that depends on the row alone, so a task that runs again deals rows alike."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
