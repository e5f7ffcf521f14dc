"""Every stage of the pipeline beside a plain version of it, on its own input."""

import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_pipeline import STAGES, run
from lucarne.llm import language, ngram_join
from lucarne.llm.queries import piece_model
from tests.llm.test_mixing import plain_targets
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ODD = [
    (9001, None, "en", "src1"), (9002, "", "en", None), (9003, "123 456", "de", "src1"), (9004, "the and that with this", None, None),
    (9005, "the and that with this", None, None), (9006, "write to a.b@c.de or +1 234 567 8901 the and", "en", "src1"), (9007, "the and of " * 3000, "en", "src2"),
    (9008, "the end and that", "en", "src1"), (9008, "the end and that", "en", "src1"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], docs.schema)
    docs.unionByName(odd).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The rows before the first stage and after each one."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append([r.asDict() for r in docs.collect()])
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}.parquet")
        docs = spark.read.parquet(f"{folder}/{i}.parquet")
        assert docs.columns[:5] == COLUMNS if i < 4 else set(COLUMNS) < set(docs.columns)
        out.append([r.asDict() for r in docs.collect()])
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_language(steps):
    before, after = steps[0], steps[1]
    gone = set(ids(before)) - set(ids(after))
    assert {9001, 9002, 9003} <= gone and len(gone) <= 5
    same = {r["doc_id"]: r for r in before}
    assert all(r == same[r["doc_id"]] for r in after)


def test_near_copies(steps):
    before, after = steps[1], steps[2]
    groups = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert ids(after) == sorted({c for _, n, c in groups if n})
    assert 9004 in ids(after) and 9005 not in ids(after)


def test_personal_data(steps):
    hidden = {r["doc_id"]: r for r in steps[3]}
    assert ids(steps[2]) == ids(steps[3])
    for r in steps[2]:
        text, spans, out, at = r["text"], sorted((s, -e, k) for k, s, e in plain(r["text"])), "", 0
        for start, end, kind in spans:
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, -end)
        assert hidden[r["doc_id"]]["text"] == out + text[at:]
    assert hidden[9006]["text"] == "write to <email> or <phone> the and" and hidden[9006]["n_chars"] == 35


def test_mixing(steps):
    before, after = steps[3], steps[4]
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    target = plain_targets(sizes, [3, 1, 2], 1.5, 2)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in sizes)
    assert max(Counter(ids(after)).values()) <= 2 and set(ids(after)) <= set(ids(before))


def test_tokens_and_run(spark, folder, steps):
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    for r in steps[5]:
        want = library.encode(r["text"], add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == r["text"]
    got = run(spark, folder).collect()
    assert sorted((r.doc_id, bytes(r["ids"])) for r in got) == sorted((r["doc_id"], bytes(r["ids"])) for r in steps[5])


def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, str(tmp_path)).count() == 0


def test_columns_called_like_those_of_operators(spark, folder):
    """Such columns pass through every filtering stage as they are."""
    names = ["language", "probability", "trigrams", "accepted", "base", "added", "size", "rate", "target", "copies", "taken", "src"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in STAGES[:4]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name


@pytest.mark.parametrize("name", ["language", "near_copies", "tokens"])
def test_batches_of_bytes(spark, folder, name):
    """Stages with Python workers hand them batches of 4 MB at most, whatever the session's setting was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, str(64 << 20))
        dict(STAGES)[name](spark, spark.read.parquet(f"{folder}/documents.parquet").limit(50), folder).count()
        assert int(spark.conf.get(key)) <= 4 << 20
        sizes = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("word "), 1000).alias("text")).mapInArrow(_sizes, "size long")
        assert max(r.size for r in sizes.collect()) <= 5 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["size"])


class Captured:
    """In place of a DataFrame: keeps the function that its workers would run."""

    schema = T.StructType([T.StructField("row", T.LongType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("made", ["profiles", "signatures", "trigrams"])
def test_memory_of_workers(monkeypatch, made):
    """Memory of a task over 4 MB of texts stays near the size of a batch, as workers keep what they have once held."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, 300)) for _ in range(1700)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string() if made == "trigrams" else pa.binary()), "row": range(1700), "text_hash": range(1700)})
    if made == "profiles":
        task = ngram_join.profiles(Captured(), 5)
    elif made == "signatures":
        task = ngram_join._all_signatures(Captured(), 5, 80)
    else:
        kept, table = [], SimpleNamespace(value=rng.random((8, language.BUCKETS)).astype(np.float32))
        monkeypatch.setattr(language, "bounded_batches", lambda *a: SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: table)))
        monkeypatch.setattr(language.F, "arrow_udf", lambda schema: lambda read: lambda column: read)
        frame = SimpleNamespace(columns=[], sparkSession=None, select=lambda *c: None)
        frame.withColumn = lambda name, read: kept.append(read) or frame
        language.read_text(frame, ([], table.value), None)
        task = lambda batches: (kept[0](b.column("text")) for b in batches)
    tracemalloc.start()
    for _ in task(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < (24 if made == "trigrams" else 10) << 20
