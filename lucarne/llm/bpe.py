"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Where two neighbouring bytes stand side by side inside no token of the vocabulary, no token can cover both, so every encoding has
a cut there, whatever the merges do around it. Together with the cuts of the pre-tokeniser these certain cuts part a text into
short fragments. Merges never cross them, so each fragment is encoded by itself and the ids are put one after another.

The pre-tokeniser's pattern is applied to the code points of a whole batch at once: the class of each (letter, number, white
space, other) and of its neighbours tells where a token starts. The classes are asked of the tokenizers library, so they are of
its Unicode version. The distinct fragments that a task has not met yet are merged in rounds over one flat array; in each round
every fragment merges the leftmost pairs of its lowest rank. Fragments above ``LONG`` bytes, which take as many rounds as they
have different merges, go through a heap of pairs instead. Encodings of fragments are kept in a table bounded by its bytes.

Special tokens found in a text are one id each (``specials=True``), or ordinary text. Nulls and empty texts have no ids and
decode to the empty text; bytes that are no UTF-8 are read as U+FFFD. Any other text decodes to itself.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lucarne.llm.pieces import _packed as packed
from lucarne.llm.pieces import _ranges as ranges
from lucarne.llm.pieces import _with_columns as with_columns
from lucarne.llm.shared import distinct

#: Fragments of more bytes are merged through a heap.
LONG = 512
#: Bytes of the table of known fragments, after which a task starts it anew.
KEPT_BYTES = 96 << 20
#: Fragments looked up in one go.
STEP = 1 << 18
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(hidden)) for b in range(256)]


def code_point_classes(pre_tokenizer) -> np.ndarray:
    """Class of each code point, as the library's pre-tokeniser has it.

    All code points in a row fall into runs of one class; the first of each run is tried after a letter, a number and a sign.
    """
    alone = lambda text: len(pre_tokenizer.pre_tokenize_str(text)) == 1
    points = np.array([c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000])
    classes = np.zeros(0x110000, dtype=np.uint8)
    row = "".join(map(chr, points.tolist()))
    for _, (begin, end) in pre_tokenizer.pre_tokenize_str(row):
        spaces = [c for c in row[begin:end] if c.isspace()]
        first = next((c for c in row[begin:end] if not c.isspace()), None)
        if first is not None:
            kind = LETTER if alone("a" + first) else NUMBER if alone("1" + first) else OTHER
            classes[points[begin:end]] = kind
        for c in spaces:
            classes[ord(c)] = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if alone(before + c)), SPACE)
    return classes


class _Numbers(dict):
    """Numbers fragments as they are met; ``take`` gives those that are new since."""

    def __init__(self):
        super().__init__()
        self.met: list[bytes] = []

    def __missing__(self, fragment: bytes) -> int:
        self.met.append(fragment)
        number = self[fragment] = len(self)
        return number

    def take(self) -> list[bytes]:
        met, self.met = self.met, []
        return met


class BytePairs:
    """Encoder and decoder for one vocabulary file (JSON of the tokenizers library) given as bytes."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        self._check(spec)
        vocabulary = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocabulary.values(), *added.values()]) + 1
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        texts = [b""] * self.size
        for token, i in vocabulary.items():
            texts[i] = bytes(map(byte_of.__getitem__, token))
        for token, i in added.items():
            texts[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.special = sorted(((token.encode(), i) for token, i in added.items()), key=lambda x: -len(x[0]))
        self.single = np.array([vocabulary[c] for c in byte_letters()], dtype=np.int32)
        self.inside = np.zeros(1 << 16, dtype=bool)
        for token in vocabulary.values():
            held = np.frombuffer(texts[token], dtype=np.uint8).astype(np.uint16)
            self.inside[held[:-1] << 8 | held[1:]] = True
        self._merges(spec["model"]["merges"], vocabulary)
        self.token_size = np.array([len(t) for t in texts], dtype=np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.known_id = np.array([bool(t) for t in texts])
        self.classes = code_point_classes(Tokenizer.from_buffer(model).pre_tokenizer)
        self._forget()

    @staticmethod
    def _check(spec: dict) -> None:
        before, model = spec["pre_tokenizer"], spec["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = before and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        ends = spec["decoder"] and spec["decoder"]["type"] == "ByteLevel" and not spec["normalizer"]
        bare = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if not (plain and split and ends and bare):
            raise ValueError("only plain byte-level BPE vocabularies are supported")

    def _merges(self, merges: list, vocabulary: dict[str, int]) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = np.full(self.size, -1)
        left, right, whole = (np.array([vocabulary[t(p)] for p in pairs], dtype=np.int64) for t in (lambda p: p[0], lambda p: p[1], "".join))
        for rank, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), whole.tolist(), strict=True)):
            if max(made[a], made[b]) >= rank:
                raise ValueError("merges that come before their parts are not supported")
            made[c] = rank
        # A token made again after it was used would let a new pair outrank the merge that made it.
        used = np.full(self.size, len(pairs))
        np.minimum.at(used, left, np.arange(len(pairs)))
        np.minimum.at(used, right, np.arange(len(pairs)))
        if (used <= made).any():
            raise ValueError("merges that come before their parts are not supported")
        key = left * self.size + right
        order = np.argsort(key)
        self.pair, self.pair_rank, self.made = key[order], order.astype(np.int32), whole.astype(np.int32)
        self.rank_of = dict(zip(key.tolist(), range(len(pairs)), strict=True))

    # -- fragments

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], _NONE)

    def merge(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the fragments and the count of each, by rounds."""
        sizes = np.array([len(f) for f in fragments], dtype=np.int64)
        symbol = self.single[np.frombuffer(b"".join(fragments), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(fragments)), sizes)
        # The rank of each symbol with the next one; the last of a fragment has none.
        rank = np.full(len(symbol), _NONE, dtype=np.int32)
        rank[:-1] = np.where(owner[:-1] == owner[1:], self._ranks(symbol[:-1], symbol[1:]), _NONE)
        ended_symbol, ended_owner = [], []
        while len(symbol):
            lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, lead)
            lowest = np.repeat(lowest, np.diff(np.append(lead, len(owner))))
            live = lowest != _NONE
            if not live.all():
                ended_symbol.append(symbol[~live])
                ended_owner.append(owner[~live])
                symbol, owner, rank, lowest = symbol[live], owner[live], rank[live], lowest[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == lowest)
            # Equal pairs that overlap merge from the left: every second one of a run.
            opens = np.concatenate([[True], np.diff(at) != 1])
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # only to carry whether the fragment goes on
            gone = np.zeros(len(symbol), dtype=bool)
            gone[at + 1] = True
            symbol, owner, rank = symbol[~gone], owner[~gone], rank[~gone]
            now = at - np.arange(len(at))
            near = np.zeros(len(symbol), dtype=bool)
            near[now] = near[np.maximum(now - 1, 0)] = True
            touched = np.flatnonzero(near)
            after = np.minimum(touched + 1, len(symbol) - 1)
            joined = (owner[touched] == owner[after]) & (after > touched)
            rank[touched] = np.where(joined, self._ranks(symbol[touched], symbol[after]), _NONE)
        symbol, owner = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (ended_symbol, ended_owner))
        return symbol[np.argsort(owner, kind="stable")].astype(np.int64), np.bincount(owner.astype(np.int64), minlength=len(fragments))

    def merge_long(self, fragment: bytes) -> list[int]:
        """Ids of one fragment by a heap of pairs, lowest rank and leftmost first."""
        symbol: list[int] = self.single[np.frombuffer(fragment, dtype=np.uint8)].tolist()
        count, rank_of, size = len(symbol), self.rank_of, self.size
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        heap = [(rank_of[key], i) for i, (a, b) in enumerate(pairwise(symbol)) if (key := a * size + b) in rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= count or rank_of.get(symbol[i] * size + symbol[j]) != rank:
                continue  # one of the two has merged meanwhile
            symbol[i], symbol[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] < count:
                before[after[i]] = i
                if (key := symbol[i] * size + symbol[after[i]]) in rank_of:
                    heapq.heappush(heap, (rank_of[key], i))
            if before[i] >= 0 and (key := symbol[before[i]] * size + symbol[i]) in rank_of:
                heapq.heappush(heap, (rank_of[key], before[i]))
        return [s for s in symbol if s >= 0]

    def _forget(self) -> None:
        self.known = _Numbers()
        self.held = 0
        self.ids = np.zeros(0, np.int64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, fragments: list[bytes]) -> None:
        size = np.array([len(f) for f in fragments])
        short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
        ids, few = self.merge([fragments[k] for k in short.tolist()])
        merged = [np.array(self.merge_long(fragments[k]), dtype=np.int64) for k in long.tolist()]
        count, start = np.zeros(len(fragments), dtype=np.int64), np.zeros(len(fragments), dtype=np.int64)
        count[short], count[long] = few, [len(m) for m in merged]
        start[short] = np.cumsum(few) - few
        start[long] = len(ids) + np.cumsum(count[long]) - count[long]
        self.held += int(size.sum()) + 150 * len(fragments)
        self.start = np.concatenate([self.start, len(self.ids) + start])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids, *merged])

    # -- texts

    def _token_starts(self, point: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Where the pre-tokeniser's pattern starts a token, for code points whose independent texts start at ``opens``.

        A run of one class is a token; one space before it belongs to it. The last white space before something else is parted
        from its run. After an apostrophe that starts a token, s, t, re, ve, m, ll and d end it.
        """
        if not len(point):
            return np.zeros(0, dtype=bool)
        kind = self.classes[point]
        first = np.zeros(len(point) + 1, dtype=bool)
        first[opens] = first[len(point)] = True
        white = kind == SPACE
        blank = point == 0x20
        start = np.ones(len(point), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) & ~(blank[:-1] & ~white[1:])
        start[:-1] |= white[:-1] & ~white[1:] & ~first[1:-1]
        start |= first[:-1]
        quote = np.flatnonzero((point == 0x27) & start)
        if len(quote):
            # The two code points after each apostrophe, 0 beyond its text.
            padded = np.concatenate([point, [0, 0]])
            inner = np.concatenate([first, [True]])
            one = np.where(inner[quote + 1], 0, padded[quote + 1])
            two = np.where(inner[quote + 1] | inner[quote + 2], 0, padded[quote + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            start[quote[short | long] + 1] = False
            for ends in (quote[short] + 2, quote[long] + 3):
                start[ends[ends < len(point)]] = True
        return start

    def _cuts(self, raw: bytes, offsets: np.ndarray, specials: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte places where fragments start, and of these the ones that are special tokens, with their ids."""
        opens = offsets[:-1][np.diff(offsets) > 0]
        found: list[tuple[int, int, int]] = []
        if specials and self.special and any(token in raw for token, _ in self.special):
            pattern = re.compile(b"|".join(re.escape(token) for token, _ in self.special))
            ids = dict(self.special)
            for begin, end in pairwise(offsets.tolist()):
                found += [(m.start(), m.end(), ids[m[0]]) for m in pattern.finditer(raw, begin, end)]
        special = np.array(found, dtype=np.int64).reshape(-1, 3)
        opens = np.unique(np.concatenate([opens, special[:, 0], special[special[:, 1] < len(raw), 1]]))
        byte = np.frombuffer(raw, dtype=np.uint8)
        lead = np.flatnonzero((byte & 0xC0) != 0x80)
        point = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
        cut = np.zeros(len(byte), dtype=bool)
        cut[lead[self._token_starts(point, np.searchsorted(lead, opens))]] = True
        if len(byte):
            cut[1:] |= ~self.inside[byte[:-1].astype(np.uint16) << 8 | byte[1:]]
        for begin, end, _ in found:
            cut[begin + 1:end] = False
        at = np.flatnonzero(cut)
        return at, np.searchsorted(at, special[:, 0]), special[:, 2]

    def encode(self, texts: pa.Array, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (an Arrow array of strings) and the count of each."""
        raw, offsets = utf8(texts)
        at, special, special_id = self._cuts(raw, offsets, specials)
        bounds = np.append(at, len(raw))
        counts, out = np.zeros(len(at), dtype=np.int64), []
        for begin in range(0, len(at), STEP):
            end = min(len(at), begin + STEP)
            fragments, which = distinct(raw, bounds[begin:end + 1])
            if self.held > KEPT_BYTES:
                self._forget()
            item = np.fromiter(map(self.known.__getitem__, fragments), dtype=np.int64, count=len(fragments))[which]
            if self.known.met:
                self._learn(self.known.take())
            count = self.count[item]
            own = (special >= begin) & (special < end)
            place = ranges(self.start[item], count)
            if own.any():
                which = special[own] - begin
                flat, count = self._with_specials(item, count, which, special_id[own])
            else:
                flat = self.ids[place]
            out.append(flat)
            counts[begin:end] = count
        total = np.concatenate([[0], np.cumsum(counts)])
        per = np.diff(total[np.searchsorted(at, offsets)])
        return np.concatenate([*out, np.zeros(0, np.int64)]), per

    def _with_specials(self, item: np.ndarray, count: np.ndarray, which: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = count.copy()
        count[which] = 1
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), dtype=np.int64)
        plain = np.ones(len(item), dtype=bool)
        plain[which] = False
        flat[ranges(begin[plain], count[plain])] = self.ids[ranges(self.start[item[plain]], count[plain])]
        flat[begin[which]] = ids
        return flat, count

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of flat ids; ids outside the vocabulary give nothing, bytes that are no UTF-8 give U+FFFD."""
        ids = ids.astype(np.int64)
        valid = (ids >= 0) & (ids < self.size)
        valid[valid] = self.known_id[ids[valid]]
        sizes = np.zeros(len(ids), dtype=np.int64)
        sizes[valid] = self.token_size[ids[valid]]
        flat = self.token_flat[ranges(self.token_at[ids[valid]], sizes[valid])]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        raw = flat.tobytes()
        inner = ends[(ends > 0) & (ends < len(raw))]
        try:
            raw.decode()
            whole = not ((flat[inner] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in pairwise(ends.tolist())], type=pa.string())


def utf8(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts in one piece and where each begins and ends; nulls are empty, broken bytes are U+FFFD."""
    array = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    raw = array.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if len(array) and ends[-1] > ends[0] else b""
    offsets = ends - ends[0] if len(array) else np.zeros(1, np.int64)
    try:
        raw.decode()
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        if not ((np.frombuffer(raw, dtype=np.uint8)[inner] & 0xC0) == 0x80).any():
            return raw, offsets
    except UnicodeDecodeError:
        pass
    mended = [x.decode("utf-8", "replace").encode() for x in array.to_pylist()]
    return b"".join(mended), np.concatenate([[0], np.cumsum([len(m) for m in mended])]).astype(np.int64)


_LOADED: dict[bytes, BytePairs] = {}


def loaded(model: bytes) -> BytePairs:
    if model not in _LOADED:
        _LOADED[model] = BytePairs(model)
    return _LOADED[model]


def round_trip(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded", specials: bool = True) -> DataFrame:
    """Each row with its ids (little-endian unsigned 32-bit integers in one binary) and the text they decode to, in one pass.

    Null and empty texts have no ids and decode to the empty text. Repeated rows repeat; an empty table stays empty. Other
    columns are kept, but for those called like the new ones, which are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        pairs = loaded(shared.value)
        flat, counts = pairs.encode(texts, specials)
        return [packed(flat, counts), pairs.decode(flat, counts)]

    return with_columns(df, [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())], text, make)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", specials: bool = True) -> DataFrame:
    """Each row with its ids as ``array<int>``; see ``round_trip`` for nulls, empty texts and other columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        flat, counts = loaded(shared.value).encode(texts, specials)
        return [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat.astype(np.int32)))]

    return with_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], text, make)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Each row with the text of its ids, given packed or as ``array<int>``; null ids, ids that are null or unknown give nothing."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    whole = isinstance(df.schema[ids].dataType, T.BinaryType)

    def rows(column: pa.Array) -> Iterator[np.ndarray]:
        for x in column.to_pylist():
            yield np.frombuffer(x or b"", dtype="<u4").astype(np.int64) if whole else np.array([i for i in x or () if i is not None], dtype=np.int64)

    def make(column: pa.Array) -> list[pa.Array]:
        given = list(rows(column))
        flat = np.concatenate([*given, np.zeros(0, np.int64)])
        return [loaded(shared.value).decode(flat, np.array([len(g) for g in given], dtype=np.int64))]

    return with_columns(df, [T.StructField(text, T.StringType())], ids, make)
