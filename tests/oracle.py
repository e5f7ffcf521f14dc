"""Run registered queries beside their SQL and compare every value.

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, db, folder: str, query, sql: str) -> tuple[bool, str]:
    """Whether both sides give the same columns and rows, in any order."""
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    relation = db.sql(sql)
    want = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    a, b = rows_of(df.columns, got), rows_of(list(relation.columns), want)
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return False, f"{len(a)} rows against {len(b)}; only here {extra}; only there {missing}"
    types = dict(df.dtypes)
    kinds = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    return True, f"{len(a)} rows" + "".join(
        f"; {c}: {types[c]} / {kinds[c]}" for c in types if not _same_kind(types[c], kinds[c])
    )


def _same_kind(spark_type: str, duck_type: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    return pairs.get(spark_type) == duck_type


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from lucarne import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__driver__memory": "8g", "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls = connect(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                good, note = compare(spark, db, folder, query, sqls[name])
            else:
                good, note = True, f"{query(spark, folder).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} bad")
