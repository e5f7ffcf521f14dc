"""Byte-level encoding and decoding beside the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lucarne.llm import bpe
from lucarne.llm.bpe import BytePairs, decode, encode, round_trip
from lucarne.llm.queries import BYTE_MODEL, op13_bpe, piece_model

MODEL = piece_model(BYTE_MODEL)
END = "<|endoftext|>"
ODD = [
    "", None, " ", "   ", "a's's 'll've it's '' ''s don't'd \t's \n 'x  'y we'rea 'S I'LL", f"{END}a{END}{END}<|endof", "text|>x", f" {END} ",
    "\n\n  \t ab \r\n", "a   ", "日本語 ﷽ 😀😀 ½ ²", "ha" * 700, "a" * 3000, "x" * 5000 + "!" * 4000 + " " * 3000, "\x00é\x00", "the same", "the same", "word " * 20000,
]


@pytest.fixture(scope="module")
def libraries():
    """The library with special tokens as ids of their own, and as ordinary text."""
    both = [Tokenizer.from_buffer(MODEL), Tokenizer.from_buffer(MODEL)]
    both[1].encode_special_tokens = True
    return both


@pytest.fixture(scope="module")
def own():
    return BytePairs(MODEL)


def same(own, libraries, texts):
    for library, specials in zip(libraries, (True, False), strict=True):
        ids, counts = own.encode(pa.array(texts, pa.string()), specials)
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        assert own.decode(ids, counts).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_odd_texts(own, libraries):
    same(own, libraries, ODD)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(own, libraries, seed):
    pick = random.Random(seed)
    tokens = [own.token_flat[a:a + n].tobytes().decode("utf-8", "ignore") for a, n in zip(own.token_at, own.token_size, strict=True)]
    same(own, libraries, ["".join(pick.choice(tokens) for _ in range(pick.randint(0, 60))) for _ in range(200)])
    same(own, libraries, ["".join(pick.choice(" '’stredlvm\n\t 　 a1!é") for _ in range(pick.randint(0, 60))) for _ in range(400)])
    points = [*range(1, 0x300), *range(0x1C80, 0x1C90), *range(0x3000, 0x3010), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640), *range(0x10D40, 0x10D60)]
    same(own, libraries, ["".join(chr(pick.choice(points)) for _ in range(pick.randint(0, 40))) for _ in range(300)])


def test_every_code_point(own, libraries):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    same(own, libraries, ["".join(points[i:i + 2000]) for i in range(0, len(points), 2000)])


def test_heap_rounds_and_small_tables_agree(own, libraries, monkeypatch):
    pick = random.Random(9)
    texts = ["".join(pick.choice("etaoin shrdlu") for _ in range(400)) for _ in range(30)] + ["".join(pick.choice("abcdef") for _ in range(20000))]
    monkeypatch.setattr(bpe, "LONG", 3)
    own._forget()
    same(own, libraries, texts)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 500)
    monkeypatch.setattr(bpe, "STEP", 7)
    same(own, libraries, texts[:10] + ODD[:12])
    own._forget()


def test_cuts_are_certain(own):
    """No token holds a pair of bytes at which a text is cut."""
    inside, special = set(), {i for _, i in own.special}
    for i, (at, size) in enumerate(zip(own.token_at, own.token_size, strict=True)):
        held = own.token_flat[at:at + size].tolist() if i not in special else []
        inside.update(zip(held, held[1:], strict=False))
    assert {(a, b) for a, b in zip(*divmod(np.flatnonzero(own.inside), 256), strict=True)} == inside


def test_decode_of_any_ids(own, libraries):
    pick = random.Random(5)
    rows = [[pick.choice([pick.randrange(own.size), pick.randrange(256), own.size + 7]) for _ in range(pick.randint(0, 12))] for _ in range(2000)]
    flat, counts = np.array([i for r in rows for i in r]), np.array([len(r) for r in rows])
    assert own.decode(flat, counts).to_pylist() == [libraries[0].decode(r, skip_special_tokens=False) for r in rows]


def test_columns_empty_tables_and_broken_bytes(spark, libraries):
    df = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(ODD)], "doc_id long, text string, decoded string, ids binary")
    got = round_trip(df, MODEL)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    want = [e.ids for e in libraries[0].encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    rows = {r.doc_id: r for r in got.collect()}
    assert [np.frombuffer(rows[i].ids, "<u4").tolist() for i in range(len(ODD))] == want
    assert [rows[i].decoded for i in range(len(ODD))] == [t or "" for t in ODD]
    assert round_trip(df.limit(0), MODEL).count() == 0
    for frame in (encode(df.drop("ids"), MODEL), got.drop("decoded")):
        assert {r.doc_id: r.decoded for r in decode(frame, MODEL).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    holes = spark.createDataFrame([(1, None), (2, [64, None, 10**6, 65])], "k int, ids array<int>")
    assert [r.decoded for r in decode(holes, MODEL).sort("k").collect()] == ["", "ab"]
    texts = pa.array([b"ok", b"a\xff\xc3", None, "é".encode()], pa.binary())
    ids, counts = bpe.loaded(MODEL).encode(texts)
    assert bpe.loaded(MODEL).decode(ids, counts).to_pylist() == ["ok", "a��", "", "é"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        BytePairs(piece_model("word_bpe_49k.json"))


def test_query(spark, tables, libraries, sha):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = op13_bpe(spark, tables(documents=docs)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = libraries[0].encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), sha(np.array(want, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(libraries[0].decode(want, skip_special_tokens=False).encode())


def test_a_batch_asks_for_each_fragment_once(monkeypatch):
    asked = []

    class Counted(bpe._Numbers):
        def __getitem__(self, fragment):
            asked.append(fragment)
            return super().__getitem__(fragment)

    monkeypatch.setattr(bpe, "_Numbers", Counted)
    ids, counts = BytePairs(MODEL).encode(pa.array([" word other" * 500, None, " word"], pa.string()))
    assert sorted(set(asked)) == [b" other", b" word"] and len(asked) < 10
    assert counts.tolist() == [1000, 0, 1] and len(set(ids.tolist())) == 2
