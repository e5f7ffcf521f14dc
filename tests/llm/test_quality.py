"""Held-out accuracy, the exchange of labels, calibration, and odd rows."""

import numpy as np
import pytest

from lucarne.llm.quality import _labels, calibration, classify
from lucarne.llm.queries import op2_quality

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Two thirds of the labels train; the others, of which some are wrong by design, are held against the result."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in classify(docs, labels.where("doc_id % 3 <> 0")).collect()}
    assert len(got) == docs.count()
    rest = labels.where("doc_id % 3 = 0").collect()
    assert np.mean([got[r.doc_id].kept == bool(r.quality) for r in rest]) >= 0.95
    assert np.mean([got[r.doc_id].kept for r in rest if r.quality]) >= 0.97


def test_query_covers_all(spark):
    rows = op2_quality(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "p_text", "p_meta", "probability", "kept"] and rows.count() == 200


def test_calibration():
    rng = np.random.default_rng(1)
    score = rng.normal(0, 3, 20000)
    good = (rng.random(20000) < 1 / (1 + np.exp(-(0.5 * score - 1)))).astype(float)
    a, b = calibration(score, good)
    assert a == pytest.approx(0.5, abs=0.05) and b == pytest.approx(-1, abs=0.1)
    assert calibration(score, 1 - good)[0] == 0.0


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "x " * 100000, "en", "a"), (None, "abc", "en", "a"), (4, "good words here", "en", "a"), (4, "good words here", "en", "a"), (5, "%%% !!! %%%", "en", "a")]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, key int, probability double")
    marks = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (1, 0), (1, 1), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    assert _labels(marks, "doc_id", "quality", 10) == {4: 1, 5: 0}
    assert len(_labels(marks, "doc_id", "quality", 1)) == 1
    for some in (marks, marks.limit(0), marks.where("quality = 1")):
        got = classify(docs, some).collect()
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4, 4, 5] and all(0 <= r.probability <= 1 for r in got)
    assert all(r.probability == 0.5 and r.kept for r in classify(docs, marks.limit(0)).collect())
    assert classify(docs.limit(0), marks).count() == 0
