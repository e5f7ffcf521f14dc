"""Encoding and decoding beside the sentencepiece library."""

import random

import numpy as np
import pytest
import sentencepiece

from lucarne.llm.pieces import Pieces, decode, encode, round_trip
from lucarne.llm.queries import op1_sentencepiece, piece_model

MODEL = piece_model()
ODD = [
    "", None, " ", "  ", "a", " a ", "  a  b ", "▁a▁ b", "\x00x", "ﬁ é", "<s> </s> <0x0A> <unk>", "日本語 ﷽ 😀😀", "\n\n\t a\r\n b",
    " " * 500 + "x" + " " * 33, "ha" * 700, "a" * 3000, "=-" * 999, "the same", "the same", "word " * 20000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def own():
    return Pieces(MODEL)


def same(own, library, texts):
    ids, counts = own.encode(texts)
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert own.decode(ids, counts) == [library.decode(w) for w in want]


def test_odd_texts(own, library):
    same(own, library, ODD)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(own, library, seed):
    pick = random.Random(seed)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, own.size)]
    letters = "abetirnostlu iiin  th"
    same(own, library, ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 60))) for _ in range(200)])
    same(own, library, ["".join(pick.choice(letters) for _ in range(pick.randint(0, 90))) for _ in range(200)])
    points = [*range(1, 0x2FF), *range(0x4E00, 0x4E80), *range(0x1F600, 0x1F640)]
    same(own, library, ["".join(chr(pick.choice(points)) for _ in range(pick.randint(0, 30))) for _ in range(100)])


def test_decode_of_any_ids(own, library):
    pick = random.Random(5)
    rows = [[pick.choice([pick.randrange(own.size), pick.randrange(259)]) for _ in range(pick.randint(0, 12))] for _ in range(2000)]
    flat, counts = np.array([i for r in rows for i in r]), np.array([len(r) for r in rows])
    assert own.decode(flat, counts) == [library.decode(r) for r in rows]


def test_columns_and_empty_tables(spark, library):
    df = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(ODD)], "doc_id long, text string, decoded string, ids binary")
    got = round_trip(df, MODEL)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    rows = {r.doc_id: r for r in got.collect()}
    assert [np.frombuffer(rows[i].ids, "<u4").tolist() for i in range(len(ODD))] == library.encode([t or "" for t in ODD], add_bos=True, add_eos=True)
    assert round_trip(df.limit(0), MODEL).count() == 0
    lists = encode(df.drop("ids"), MODEL)
    for frame in (lists, got.drop("decoded")):
        texts = {r.doc_id: r.decoded for r in decode(frame, MODEL).collect()}
        assert texts == {i: library.decode(library.encode(t or "")) for i, t in enumerate(ODD)}
    holes = spark.createDataFrame([(1, None), (2, [1, None, 264, 2])], "k int, ids array<int>")
    assert [r.decoded for r in decode(holes, MODEL).sort("k").collect()] == ["", "a"]


def test_query(spark, tables, library, sha):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in op1_sentencepiece(spark, tables(documents=docs)).collect():
        want = library.encode(ODD[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(want), sha(np.array(want, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(library.decode(want).encode())
