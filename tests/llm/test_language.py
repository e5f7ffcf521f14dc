"""Held-out accuracy, the fusion beside plain arithmetic, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucarne.llm.language import BUCKETS, address_parts, declared_language, identify, page_text, train, trigrams
from lucarne.llm.queries import op10_language_id

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return train(documents.where("doc_id % 2 = 0"), "text", "lang")


def test_held_out_accuracy(documents, model):
    assert model[0] == ["de", "en", "es", "fr", "und"] and model[1].shape == (5, BUCKETS)
    rows = identify(documents.where("doc_id % 2 = 1"), model).collect()  # text alone
    assert np.mean([r.language == r.lang for r in rows]) >= 0.97
    assert "text" not in rows[0] and {"doc_id", "source", "accepted"} <= set(rows[0].asDict())


def test_training_counts(spark):
    rows = [("one two", "a"), ("TWO; one", "a"), ("drei", "b"), (None, "b"), ("lost", None)] * 3
    names, table = train(spark.createDataFrame(rows, "text string, label string").repartition(4), "text", "label", least=1)
    assert names == ["a", "b", "und"]
    for name, texts in (("a", ["one two", "TWO; one"]), ("b", ["drei"])):
        counts = np.full(BUCKETS, 0.5)
        for _, bucket in trigrams(texts * 3):
            counts += np.bincount(bucket, minlength=BUCKETS)
        assert np.allclose(table[names.index(name)], np.log(counts / counts.sum()))
    assert train(spark.createDataFrame(rows, "text string, label string").limit(0), "text", "label")[0] == ["und"]


def test_steps_cover_long_texts(monkeypatch):
    from lucarne.llm import language

    texts = ["ab cde", None, "", "x", "école", "the end " * 50]
    whole = [(o.tolist(), b.tolist()) for o, b in trigrams(texts)]
    monkeypatch.setattr(language, "STEP", 5)
    parts = list(trigrams(texts))
    assert [sum((o.tolist() for o, _ in parts), []), sum((b.tolist() for _, b in parts), [])] == [whole[0][0], whole[0][1]]


def test_fusion(spark, model):
    """Text without a clear language is settled by declared language, suffix and host, as plain arithmetic has it."""
    en, fr = "the and that with this from have", "les dans pour que des avec une éèê"
    rows = [(i, en, "en", "com/en", "h1", "d1") for i in range(6)] + [(10 + i, fr, "fr", "com/fr", "h2", "d1") for i in range(6)]
    rows += [(30, "qx", "fr", "com/fr", "h2", "d1"), (31, "qx", None, None, None, None), (32, "qx", "en", None, "h1", "d1")]
    df = spark.createDataFrame(rows, "id int, text string, lang string, suffix string, host string, domain string")
    got = {r.id: r for r in identify(df, model, declared=F.col("lang"), suffix=F.col("suffix"), host=F.col("host"), domain=F.col("domain")).collect()}
    assert got[0].language == "en" and got[10].language == "fr" and got[0].accepted

    names, table = model
    size, best, like = len(names), {}, {}
    for i, text, *_ in rows:
        total = sum(table.astype(np.float32)[:, b].astype(float).sum(axis=1) for _, b in trigrams([text]))
        count = sum(len(b) for _, b in trigrams([text]))
        like[i] = total * min(1, 100 / count)
        best[i] = int(like[i].argmax())
    eye = np.eye(size)
    all_ = sum(eye[best[i]] for i in best)
    base = (all_ + 0.5) / (all_.sum() + 0.5 * size)
    for i, _, lang, suffix, host, domain in rows:
        score = like[i].copy()
        for at, value in ((2, lang), (3, suffix)):
            if value is not None:
                mine = sum((eye[best[r[0]]] for r in rows if r[at] == value), np.zeros(size))
                given = sum(eye[best[r[0]]] for r in rows if r[at] is not None)
                score += np.log((mine + 0.5) / (given + 0.5 * len({r[at] for r in rows} - {None})))
        near, wide = (sum(eye[best[r[0]]] for r in rows if (r[at] or "") == (v or "")) - eye[best[i]] for at, v in ((4, host), (5, domain)))
        prior = (wide + 5 * base) / (wide.sum() + 5)
        score += np.log((near + 5 * prior) / (near.sum() + 5))
        share = np.exp(score - score.max())
        share /= share.sum()
        assert got[i].language == names[int(share.argmax())] and math.isclose(got[i].probability, share.max(), rel_tol=1e-4)


def test_odd_rows(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", None), (4, "the and that", None), (4, "the and that", None), (None, "les dans pour", "fr"), (5, "the " * 100000, "zz"), (6, "\x00퟿", "en")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id int, text string, lang string, language string, row int, best int")
    got = identify(df, model, declared=F.col("lang"))
    assert got.columns == ["doc_id", "lang", "row", "best", "language", "probability", "trigrams", "accepted"]
    by = {r.doc_id: r for r in got.collect()}
    assert all((by[i].language, by[i].probability, by[i].accepted) == ("und", 1.0, False) for i in (1, 2, 3))
    assert by[5].language == "en" and (by[5].row, by[5].best) == (1, 2)
    assert identify(df.limit(0), model).count() == 0


def test_page_evidence(spark):
    html = '<!DOCTYPE html><HTML class=x lang="FR-ca"><script>var a="</p>";</script><p>un&nbsp;<b>deux</b><!-- trois --></html>'
    df = spark.createDataFrame([(html,), (None,), ("<html>x",)], "html string")
    rows = df.select(declared_language(F.col("html")).alias("d"), page_text(F.col("html")).alias("t")).collect()
    assert [r.d for r in rows] == ["fr", None, None] and rows[0].t.split() == ["un", "deux"] and rows[1].t is None
    hosts = spark.createDataFrame([("a.b.example.fr", "/en/x"), ("fr", "/eng/"), ("", "")], "host string, path string")
    got = [tuple(r) for r in hosts.select(*address_parts(F.col("host"), F.col("path"))).collect()]
    assert got == [("fr/en", "example.fr"), ("fr/", "fr"), (None, "")]


def test_query(spark):
    rows = op10_language_id(spark, FOLDER).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", declared_language(F.col("html")).alias("d")).collect()
    assert len(rows) == len(docs) + len(pages)
    assert np.mean([r.language == docs[r.doc_id] and r.kept for r in rows if r.doc_id is not None]) >= 0.97
    declared = {p.page_id: p.d for p in pages}
    assert np.mean([r.language == declared[r.page_id] for r in rows if r.page_id is not None]) >= 0.97


def test_rare_and_many_labels(spark):
    greek = ["καλημέρα σε όλους", "το σπίτι είναι μεγάλο", "πού είναι ο σταθμός"]
    rows = [(f"the house and the garden with this {i}", "en-US" if i % 2 else "en_GB") for i in range(60)] + [(t, "el") for t in greek]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = train(df, "text", "lang")
    assert model[0] == ["el", "en", "und"]
    found = identify(df, model, declared=F.col("lang")).collect()
    assert all(r.accepted and r.language == ("el" if r.lang == "el" else "en") for r in found)
    many = spark.createDataFrame([(f"word{i} " * 200, f"{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(130)], "text string, lang string")
    model = train(many, "text", "lang")
    assert len(model[0]) == 131
    assert identify(many, model, declared=F.col("lang")).count() == 130
    with pytest.raises(ValueError, match="more than 9 languages"):
        train(many, "text", "lang", max_bytes=10 * 4 * BUCKETS)
