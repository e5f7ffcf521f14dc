"""URL filters by Bloom filter cascades.

A rule is a host and the beginning of a path; it fits its host and all subdomains where the path starts with the rule's, and
the longest rule decides. A rule's shape is the number of its host's labels and the length of its path; a page's candidate keys are
the suffix of its host and the beginning of its path of every shape that occurs among the rules. All distinct candidate keys of the corpus are the universe.

Per list (block, allow) a cascade answers membership over that universe exactly: level 1 holds the listed keys, level 2 the
unlisted keys of the universe that pass level 1, level 3 the listed keys that pass level 2, and so on until nothing passes
wrongly. A key is listed if the first level that it fails is even, or if it passes all of an odd number of levels. Every
level is hashed anew from 128 bits of the key, so keys part after a few levels; the operator refuses if they do not.

Only filters are broadcast; ``max_bytes`` bounds them all together, and a longer list is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucarne.llm.shared import Staging, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LEVELS = 40


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: F.Column, path: F.Column, shapes: list[tuple[int, int]]) -> F.Column:
    """Host suffixes of so many labels joined with path beginnings of such lengths; empty hosts have none.

    Only shapes of rules are spelled out, so a host of any number of labels costs no more than one of few.
    """
    listed = F.from_json(F.lit(json.dumps([{"labels": m, "length": n} for m, n in shapes])), "array<struct<labels int, length int>>")
    dots, long = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))), F.length(path)
    fits = F.filter(listed, lambda x: (x["labels"] <= dots + 1) & (x["length"] <= long))
    keys = F.transform(fits, lambda x: F.concat(F.call_function("substring_index", host, F.lit("."), -x["labels"]), F.substring(path, F.lit(1), x["length"])))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def _hashes(key: F.Column) -> list[F.Column]:
    return [F.xxhash64(F.lit(seed), key) for seed in ("first", "second")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter: ``bits`` is a packed bit set of a power of two, probed ``probes`` times."""

    number: int
    probes: int
    bits: np.ndarray

    @staticmethod
    def sized(number: int, keys: int, share: float) -> Level:
        probes = max(1, round(-np.log2(share)))
        need = max(64.0, keys * -np.log(share) / np.log(2) ** 2)
        return Level(number, probes, np.zeros(1 << int(np.ceil(np.log2(need)) - 3), dtype=np.uint8))

    def places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        salt = _mix(np.array([self.number + 1], dtype=np.uint64))
        first, step = _mix(a ^ salt), _mix(b + salt) | np.uint64(1)
        for i in range(self.probes):
            yield ((first + np.uint64(i) * step) & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64)

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        held = np.ones(len(a), dtype=bool)
        for at in self.places(a, b):
            held &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return held


def listed(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys, given by both hashes, are listed; exact for keys of the universe."""
    undecided, found = np.arange(len(a)), np.zeros(len(a), dtype=bool)
    for k, level in enumerate(levels):
        held = level.passes(a[undecided], b[undecided])
        found[undecided[~held]] = k % 2 == 1
        undecided = undecided[held]
    found[undecided] = len(levels) % 2 == 1
    return found


def _u64(column) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def build_cascade(universe: DataFrame, keys: DataFrame, share: float = 0.01, max_bytes: int = 64 << 20) -> list[Level]:
    """The cascade for listed ``keys`` over ``universe``; both hold distinct hash pairs ``a``, ``b`` and are read once a level.

    The bits of a level are set inside the tasks and combined by one bitwise aggregation over blocks of 4 KB.
    """
    spark, levels = universe.sparkSession, []
    others = universe.join(keys, ["a", "b"], "left_anti")
    sides = [keys, others]
    while True:
        number = len(levels)
        if number == MAX_LEVELS:
            raise RuntimeError("the keys do not part")
        rows = sides[number % 2]
        if number:
            shared = spark.sparkContext.broadcast(list(levels))
            rows = _passing(rows, shared, number)
        count = rows.count()
        if number and not count:
            return levels
        # Half the bits of a set level; later levels see few keys and need no finer filter than one in two.
        level = Level.sized(number, count, share if number == 0 else 0.5)
        if sum(x.bits.nbytes for x in [*levels, level]) > max_bytes:
            raise ValueError(f"the filters need more than {max_bytes} bytes")
        for block, bits in _set_bits(rows, level).toLocalIterator():
            level.bits[block * 4096:block * 4096 + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
        levels.append(level)


def _passing(rows: DataFrame, shared, number: int) -> DataFrame:
    """Rows of one side that every second level so far has let through wrongly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = _u64(batch["a"]), _u64(batch["b"])
            held = np.ones(len(batch), dtype=bool)
            for level in shared.value[:number]:
                held &= level.passes(a, b)
            yield batch[held]

    return rows.select("a", "b").mapInPandas(run, "a long, b long")


def _set_bits(rows: DataFrame, level: Level) -> DataFrame:
    """Blocks of the level's bits: one row per touched block."""
    empty = Level(level.number, level.probes, np.zeros_like(level.bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Level(empty.number, empty.probes, np.zeros_like(empty.bits))
        for batch in batches:
            for at in own.places(_u64(batch["a"]), _u64(batch["b"])):
                np.bitwise_or.at(own.bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        for block in range(0, -(-len(own.bits) // 4096)):
            bits = own.bits[block * 4096:(block + 1) * 4096]
            if bits.any():
                yield pd.DataFrame({"block": [block], "bits": [bits.tobytes()]})

    def union(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in group["bits"]])
        return pd.DataFrame({"block": group["block"][:1], "bits": [bits.tobytes()]})

    # At most one row per task and block comes together.
    return rows.mapInPandas(run, "block long, bits binary").groupBy("block").applyInPandas(union, "block long, bits binary")


def judge(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Each row with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``rules`` has host, path and verdict (``block`` or ``allow``). Of rules that fit, the one with the longest text (host and
    path) decides; a rule listed twice counts once, one listed both ways blocks. Rows that no rule fits, null urls and urls
    without a host get the verdict ``otherwise`` and a null rule. An empty rule list fits nothing. Hosts and paths may have any
    length. The driver sees the distinct shapes of the rules, two numbers each.
    """
    spark = df.sparkSession
    rules = rules.dropna(subset=["host", "path", "verdict"])
    labels = F.size(F.split("host", r"\.")).alias("labels")
    shapes = sorted((r.labels, r.length) for r in rules.select(labels, F.length("path").alias("length")).distinct().toLocalIterator())
    made = ("host", "path", "rule", "verdict")
    kept = df.select(*(c for c in df.columns if c.lower() not in made))
    host, path = split_url(F.col(url))
    parts = kept.withColumns({"host": host, "path": path})
    if not shapes:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})

    staging = Staging(spark, "url-keys")
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    a, b = _hashes(F.col("key"))
    universe = staging.keep(parts.select("host", "path").distinct().select(F.explode(keys).alias("key")).select(a.alias("a"), b.alias("b")).distinct())
    wanted = rules.select(F.concat(F.col("host"), F.col("path")).alias("key"), "verdict").groupBy("key").agg(F.max("verdict").alias("verdict"))
    wanted = wanted.select(a.alias("a"), b.alias("b"), "verdict").join(universe, ["a", "b"], "left_semi")
    wanted = staging.keep(wanted)
    cascades = {v: build_cascade(universe, wanted.where(F.col("verdict") == v).select("a", "b")) for v in ("block", "allow")}
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("struct<place int, verdict string>")
    def decide(firsts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(x) for x in firsts], dtype=np.int64)
        flat = [_u64(np.concatenate([*s, np.zeros(0, np.int64)])) for s in (firsts, seconds)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        best, verdict = np.full(len(sizes), -1), np.full(len(sizes), None, dtype=object)
        for name, levels in shared.value.items():
            hit = np.flatnonzero(listed(levels, *flat))
            for row, at in zip(owner[hit].tolist(), place[hit].tolist(), strict=True):
                if best[row] < 0 or at < best[row]:
                    best[row], verdict[row] = at, name
        return pd.DataFrame({"place": best.astype(np.int32), "verdict": verdict})

    ordered = F.array_sort(keys, lambda x, y: F.coalesce(F.nullif(F.length(y) - F.length(x), F.lit(0)), F.when(x < y, -1).when(x > y, 1).otherwise(0)))
    all_keys, found = fresh(parts, "keys"), fresh(parts, "found")
    judged = parts.withColumn(all_keys, ordered).withColumn(
        found, decide(F.transform(all_keys, lambda k: _hashes(k)[0]), F.transform(all_keys, lambda k: _hashes(k)[1]))
    )
    return judged.select(
        *kept.columns, "host", "path",
        F.when(F.col(f"{found}.place") >= 0, F.get(all_keys, F.col(f"{found}.place"))).alias("rule"),
        F.coalesce(f"{found}.verdict", F.lit(otherwise)).alias("verdict"),
    )
