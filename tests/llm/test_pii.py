"""Base spans beside the plain expressions in Python, and the bootstrap on a corpus with known patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lucarne.llm.pii import KINDS, find, in_order, redacted
from lucarne.llm.queries import op8_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    None, "", " ", "a@b.c", "a@b.c%d@e.f", "x@y a@b..c a@-.- @a.b a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 001.02.3.000", "1.2.3 .4.5.6.7",
    "4111 1111 1111 1111", "4111-1111-1111-1111.", "4111  1111 1111 1111", "4111111111111112", "0" * 13, "0" * 20, "+1 (375) 555-4393x", "+1+1+12345678901", "+1 ( ",
    "+123456789012345678", "😀 é a.b@c.d 😀 10.0.0.1", "é@é.é a@b.cé", "a" * 3000, "1" * 3000, "1 " * 3000, "a@" * 3000, "a.b@c.d " * 400, "1.1." * 3000, "1.1.1.1." * 300, "+1" * 3000, "x\ny@z.w\n+1 234 567 8901\r\n",
]


def base_of(rows):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in rows}


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "b", 7) for i, t in enumerate(ODD)], "doc_id int, text string, base string, row int")
    got = find(df)
    assert got.columns == ["doc_id", "row", "base", "added"]
    rows = got.collect()
    assert base_of(rows) == {i: plain(t) for i, t in enumerate(ODD)}
    assert all(s.value == ODD[r.doc_id][s.start:s.end] for r in rows for s in r.base)
    assert find(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Runs of 100,000 characters take linear time and no deep recursion."""
    parts = ["a", "1", "1 ", "1.", "a@", "+", "a.", "1-"]
    df = spark.createDataFrame([(i, p * (100_000 // len(p)) + " x@y.zz") for i, p in enumerate(parts)], "doc_id int, text string")
    assert all("x@y.zz" in [s.value for s in r.base] for r in find(df).collect())


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, seed):
    pick = random.Random(seed)
    parts = ["a", "B9", "@", ".", "-", "+", "%", " ", "1", "22", "255", "4111", "1111", "(", ")", "é", "😀", "\n", "x@y.z", "10.1.2.3", "+1 234 567 89", "4111111111111111"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 40))) for _ in range(700)]
    rows = find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert base_of(rows) == {i: plain(t) for i, t in enumerate(texts)}


def corpus():
    """Phone numbers after "tel:" or "call", half of them without prefix; other numbers after "no." and everywhere."""
    pick = random.Random(1)
    rows = []
    for i in range(120):
        number = f"{pick.randint(200, 999)}-{pick.randint(200, 999)}-{pick.randint(1000, 9999)}"
        prefix = "+1 " if i % 2 else ""
        rows.append((i, f"bla {pick.choice(['tel:', 'call '])}{prefix}{number} or so, order no. {pick.randint(10**6, 10**7)} and 12 more"))
    return rows


def test_bootstrap(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in find(df, seeds=5).collect()}
    for i, text in rows:
        added = [(s.kind, text[s.start:s.end]) for s in got[i].added]
        number = re.search(r"\d{3}-\d{3}-\d{4}", text).group()
        assert added == ([] if i % 2 else [("phone", number)]), text
        assert [(s.kind, s.start, s.end) for s in got[i].base] == plain(text)
    # Copies of one document are one instance and make no pattern.
    copies = spark.createDataFrame([(i, "tel: +1 234 567 8901") for i in range(50)] + [(99, "tel: 234-567-8902")], "doc_id int, text string")
    assert all(not r.added for r in find(copies, seeds=5).collect())


def test_query_and_redaction(spark, tables, sha):
    docs = spark.createDataFrame([*corpus(), (None, None), (500, "a@b.c 1.2.3.4"), (500, "a@b.c 1.2.3.4")], "doc_id long, text string")
    rows = op8_pii(spark, tables(documents=docs)).collect()
    assert len(rows) == 123
    for r in rows:
        if r.doc_id is None:
            assert (r.n_email, r.n_phone, r.base_sha256, r.spans) == (0, 0, sha(b""), "")
        elif r.doc_id == 500:
            assert (r.n_email, r.n_ip, r.spans, r.base_sha256) == (1, 1, "email:0:5,ip:6:13", sha(b"email:0:5,ip:6:13"))
    hidden = find(docs, keep_text=True).withColumn("out", redacted(F.col("text"), F.concat("base", "added")))
    assert {r.out for r in hidden.where("doc_id is null or doc_id = 500").collect()} == {None, "<email> <ip>"}
    crossed = spark.createDataFrame([("abcdefgh", [("x", 1, 4), ("y", 2, 6), ("x", 6, 7)])], "t string, s array<struct<kind: string, start: int, end: int>>")
    assert crossed.select(redacted(F.col("t"), F.col("s"))).first()[0] == "a<x><x>h"
    assert crossed.select(in_order(F.transform("s", lambda s: s.withField("kind", F.lit("ip"))))).first()[0] == "ip:1:4,ip:2:6,ip:6:7"
