"""Alignment beside all pairs of tokens of the two libraries."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lucarne.llm import alignment
from lucarne.llm.alignment import align, common_ends, links
from lucarne.llm.bpe import byte_letters
from lucarne.llm.queries import BYTE_MODEL, op11_alignment, piece_model

BYTES, PIECES = piece_model(BYTE_MODEL), piece_model()
ODD = [
    "", None, " ", "  a  b ", "▁a", "x ▁ y", "<|endoftext|> <s> <0x0A>", "日本語 ﷽ 😀😀 ½", "\n\n\t a\r\n b", "ha" * 300, "the same text", "the same text",
    "naïve café costs 1234567 dollars, don't they're", "word " * 3000, " " * 90 + "x", "\x00a",
]


@pytest.fixture(scope="module")
def brute():
    a_lib, b_lib = Tokenizer.from_buffer(BYTES), sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    a_lib.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_letters())}

    def of_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(tokens):
        out, at = [], 0
        for token in tokens:
            out.append((at, at + len(token)))
            at += len(token)
        return out

    def run(texts):
        docs = []
        for text in texts:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
            b = b_lib.encode(text) if text else []
            a_bytes, b_bytes = [bytes(byte_of[c] for c in a_lib.id_to_token(i)) for i in a], [of_b(i) for i in b]
            if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
                docs.append(([], [], [], ""))
                continue
            a_span, b_span = spans(a_bytes), spans(b_bytes)
            links = [(a[i], b[j]) for i, x in enumerate(a_span) for j, y in enumerate(b_span) if x[0] < y[1] and y[0] < x[1]]
            ends = sorted({x[1] for x in a_span} & {y[1] for y in b_span})
            groups = [
                ",".join(str(i) for i, x in zip(a, a_span, strict=True) if lo < x[1] <= hi) + "|" + ",".join(str(i) for i, y in zip(b, b_span, strict=True) if lo < y[1] <= hi)
                for lo, hi in zip([0, *ends], ends, strict=False)
            ]
            docs.append((a, b, links, ";".join(groups)))
        count = Counter(pair for d in docs for pair in set(d[2]))
        highest = {}
        for (x, _), n in count.items():
            highest[x] = max(n, highest.get(x, 0))
        return [
            (len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), g)
            for a, b, links, g in docs
        ]

    return run


def texts(seed, n=60):
    pick = random.Random(seed)
    words = ["the", "Theory", "encyclopedia", "don't", "1234", "naïve", "zq", "über", "日本", "--", "e.g.", "unbelievably", "xkcdq", "\n", "  "]
    return ["".join(pick.choice(words) + pick.choice([" ", "", " ", ", "]) for _ in range(pick.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("most", [alignment.MOST, 40, 1])
def test_against_all_pairs(spark, brute, most):
    rows = [t if t is None else t[:600] for t in ODD] + texts(1)
    df = spark.createDataFrame([(i, t, i % 3, "x") for i, t in enumerate(rows)], "doc_id long, text string, pairs int, n_links string")
    got = align(df, BYTES, PIECES, most=most)
    assert got.columns == ["doc_id", "pairs", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    found = {r[0]: r for r in got.collect()}
    assert [tuple(found[i])[2:] for i in range(len(rows))] == brute(rows)
    assert [found[i].pairs for i in range(len(rows))] == [i % 3 for i in range(len(rows))]


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0


def test_windows_and_slices():
    a_ends, b_ends = [1, 2, 9, 10, 14, 20, 21], [2, 5, 8, 10, 16, 21]
    for window in range(25):
        assert common_ends(a_ends, b_ends, window) == ([2, 4, 7], [1, 4, 6])
    a, b = links(np.array(a_ends), np.array(b_ends), np.array([0, 2, 4, 7]), np.array([0, 1, 4, 6]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 3), (4, 4), (5, 4), (5, 5), (6, 5)]
    assert common_ends([], []) == ([], [])


def test_query(spark, tables, brute, sha):
    rows = [t if t is None else t[:600] for t in ODD] + texts(2, 20)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute(rows)
    got = op11_alignment(spark, tables(documents=docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[r.doc_id][:6]
        assert r.groups_sha256 == (sha(want[r.doc_id][6].encode()) if r.n_a else "")


def test_ends_of_several_texts_meet_in_one_go():
    """The ends of all texts of a part are one array; windows part it anywhere."""
    rng = np.random.default_rng(3)
    a_end, b_end = (np.unique(np.append(rng.integers(1, 4000, 1500), 4000)) for _ in range(2))
    common = np.intersect1d(a_end, b_end)
    for window in (0, 7, 1000, 1 << 20):
        a_cut, b_cut = alignment.common_places(a_end, b_end, window)
        assert (a_end[a_cut - 1] == common).all() and (b_end[b_cut - 1] == common).all()
