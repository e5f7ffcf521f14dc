"""SentencePiece encoding and decoding by vectorised merge rounds.

A chunk of texts is cut into words at spaces. The distinct words that the task has not met yet become one flat array of
symbols. In each round every word finds its lowest pair rank by a segmented minimum, the leftmost non-overlapping pairs of
that rank merge at once in all words, and the array is compacted; words without a known pair leave. Encodings of words are
kept in a table of bounded size, and texts are put together from it by array gathers.

Merging equal pairs at once gives what the library's queue gives, which takes the best score first and the leftmost among
equals, unless a merge makes a pair that outranks its own. Where the vocabulary allows that (``_Tables.unsafe``), only the
first occurrence of each cluster merges in a round; clusters lie further apart than the longest piece, so they cannot meet.

Nulls and empty texts have no pieces: begin and end ids only, and decode to the empty text. Any other text decodes to itself
with U+2581 read as a space, as in the library.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lucarne.llm.shared import BATCH, bounded_batches, distinct, reachable, slices

SPACE = "▁"
#: Words whose encoding a task keeps before it starts anew.
KEPT_WORDS = 300_000
#: Bytes of texts encoded in one go; smaller parts meet the same words more often.
PART = 1 << 20


class Pieces:
    """Encoder and decoder for one model file given as bytes (BPE with byte fallback, identity normaliser)."""

    def __init__(self, model: bytes):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = spm.vocab_size()
        self.size, self.bos, self.eos = size, spm.bos_id(), spm.eos_id()
        names = [spm.id_to_piece(i) for i in range(size)]
        special = np.array([spm.is_control(i) or spm.is_unknown(i) or spm.is_byte(i) for i in range(size)])
        if any(spm.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces are not supported")
        known = {names[i]: i for i in np.flatnonzero(~special).tolist()}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in known):
            raise ValueError("pieces that span words are not supported")
        self.byte_id = np.array([spm.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self._chars(known)
        self._pairs(known, spm)
        self._spaces(known, spm)
        self._surfaces(names, special, spm)
        self._forget()

    def _chars(self, known: dict[str, int]) -> None:
        single = sorted((ord(p), i) for p, i in known.items() if len(p) == 1)
        self.code, self.code_id = (np.array(x, dtype=np.int64) for x in zip(*single, strict=True))

    def _pairs(self, known: dict[str, int], spm) -> None:
        score = {i: spm.get_score(i) for i in known.values()}
        order = {s: rank for rank, s in enumerate(sorted(set(score.values()), reverse=True))}
        found, unsafe = [], set()
        for piece, i in known.items():
            if not piece.strip(SPACE):
                continue  # runs of spaces never enter the rounds
            for cut in range(1, len(piece)):
                left, right = known.get(piece[:cut]), known.get(piece[cut:])
                if left is None or right is None:
                    continue
                found.append((left * self.size + right, order[score[i]], i))
                unsafe.update(part for part in (left, right) if score[i] >= score[part] and len(spm.id_to_piece(part)) > 1)
        self.pair, self.pair_rank, self.pair_id = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        self._slots()
        self.unsafe = np.zeros(self.size, dtype=bool)
        self.unsafe[list(unsafe)] = True
        if len(set(self.pair_rank.tolist())) != len(set(self.pair_id.tolist())):
            raise ValueError("pieces of equal score are supported for runs of spaces only")
        self.longest = max(len(p) for p in known)

    def _slots(self) -> None:
        """Hash table of the pairs: each lies at most ``probes`` places after its own slot."""
        self.bits = int(np.ceil(np.log2(8 * len(self.pair))))
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        left, self.probes = np.arange(len(self.pair), dtype=np.int32), 0
        while len(left):
            at = self._slot(self.pair[left], self.probes)
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            left = left[self.slot[at] != left]
            self.probes += 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def _spaces(self, known: dict[str, int], spm) -> None:
        """Runs of spaces merge last, leftmost first: the longest piece over and over, then what the merges make of the rest."""
        score = {len(p): spm.get_score(i) for p, i in known.items() if not p.strip(SPACE)}
        others = [spm.get_score(i) for p, i in known.items() if len(p) > 1 and p.strip(SPACE)]

        def merged(run: list[int]) -> list[int]:
            while True:
                pairs = [(-score[a + b], k) for k, (a, b) in enumerate(itertools.pairwise(run)) if a + b in score]
                if not pairs:
                    return run
                at = min(pairs)[1]
                run = [*run[:at], run[at] + run[at + 1], *run[at + 2:]]

        longest = max(score)
        rests = [merged([1] * n) for n in range(3 * longest)]
        if 1 not in score or min(others) <= max([s for n, s in score.items() if n > 1], default=-np.inf) or any(
            rests[n] != [longest, *rests[n - longest]] for n in range(longest, 3 * longest)
        ):
            raise ValueError("runs of spaces in this model are not supported")
        self.space_id, self.run, self.run_id = known[SPACE], longest, known[SPACE * longest]
        self.rest_count = np.array([len(r) for r in rests[:longest]])
        self.rest_at = np.cumsum(self.rest_count) - self.rest_count
        self.rest_id = np.array([known[SPACE * n] for r in rests[:longest] for n in r], dtype=np.int64)

    def _surfaces(self, names: list[str], special: np.ndarray, spm) -> None:
        texts = []
        for i, name in enumerate(names):
            if spm.is_byte(i):
                texts.append(bytes([int(name[3:5], 16)]))
            elif spm.is_unknown(i):
                texts.append(" ⁇ ".encode())
            else:
                texts.append(b"" if special[i] else name.replace(SPACE, " ").encode())
        self.text = texts
        self.text_size = np.array([len(t) for t in texts])
        self.text_at = np.concatenate([[0], np.cumsum(self.text_size)[:-1]])
        self.text_flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.spaced = np.array([n.startswith(SPACE) for n in names]) & ~special
        self.is_byte = np.array([spm.is_byte(i) for i in range(self.size)])

    # -- merge rounds

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 where the two do not merge."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        found = self.slot[self._slot(key, 0)]
        wrong = np.flatnonzero((found >= 0) & (self.pair[found] != key))
        for probe in range(1, self.probes):
            if not len(wrong):
                return found
            found[wrong] = self.slot[self._slot(key[wrong], probe)]
            again = found[wrong]
            wrong = wrong[(again >= 0) & (self.pair[again] != key[wrong])]
        found[wrong] = -1
        return found

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of the words and each word's count; symbol -1-c is a character c without a piece."""
        sizes = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        symbol = np.where(self.code[at] == code, self.code_id[at], -1 - code).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        none = np.iinfo(np.int32).max
        rank_of = np.append(self.pair_rank, none).astype(np.int32)  # the last for "no pair", -1
        pair = np.full(len(symbol), -1, dtype=np.int32)
        pair[:-1] = np.where(word[:-1] == word[1:], self._lookup(symbol[:-1], symbol[1:]), -1)
        done_symbol, done_word = [], []
        while len(symbol):
            rank = rank_of[pair]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            per = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            ended = per == none
            if ended.any():
                done_symbol.append(symbol[ended])
                done_word.append(word[ended])
                symbol, word, pair, rank, per = (x[~ended] for x in (symbol, word, pair, rank, per))
                if not len(symbol):
                    break
            chosen = self._leftmost(np.flatnonzero(rank == per), word, pair)
            symbol[chosen] = self.pair_id[pair[chosen]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[chosen + 1] = False
            symbol, word, pair = symbol[keep], word[keep], pair[keep]
            # Only the pairs on either side of a merged symbol are new.
            new = chosen - np.arange(len(chosen))
            near = np.zeros(len(symbol), dtype=bool)
            near[new] = near[np.maximum(new - 1, 0)] = True
            new = np.flatnonzero(near)
            after = np.minimum(new + 1, len(symbol) - 1)
            same = (word[new] == word[after]) & (after > new)
            pair[new] = np.where(same, self._lookup(symbol[new], symbol[after]), -1)
        word = np.concatenate([*done_word, np.zeros(0, np.int32)])
        symbol = np.concatenate([*done_symbol, np.zeros(0, np.int32)])[np.argsort(word, kind="stable")]
        return symbol.astype(np.int64), np.bincount(word, minlength=len(words))

    def _leftmost(self, at: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of the places of lowest rank, those that merge now."""
        fresh = np.concatenate([[True], (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        if self.unsafe[self.pair_id[pair[at]]].any():
            apart = np.concatenate([[True], (np.diff(at) > 2 * self.longest) | (word[at[1:]] != word[at[:-1]])])
            at = at[apart | ~self.unsafe[self.pair_id[pair[at]]]]
        return at

    # -- texts

    def _forget(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, np.int64)
        self.start, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.lone = np.ones(1, bool)  # whether the word's own space stays a piece by itself

    def _learn(self, words: list[str]) -> None:
        symbol, count = self.merge([SPACE + w for w in words])
        begin = np.cumsum(count) - count
        lone = symbol[begin] == self.space_id
        keep = np.ones(len(symbol), dtype=bool)
        keep[begin[lone]] = False
        owner = np.repeat(np.arange(len(words)), count)[keep]
        symbol = symbol[keep]
        raw = symbol < 0
        if raw.any():
            code = -1 - symbol[raw]
            parts = [chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()]
            widths = np.ones(len(symbol), dtype=np.int64)
            widths[raw] = [len(p) for p in parts]
            wide, owner = np.repeat(symbol, widths), np.repeat(owner, widths)
            wide[np.repeat(raw, widths)] = self.byte_id[np.frombuffer(b"".join(parts), dtype=np.uint8)]
            symbol = wide
        count = np.bincount(owner, minlength=len(words))
        base = len(self.words)
        self.words.update((w, base + k) for k, w in enumerate(words))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.lone = np.concatenate([self.lone, lone])
        self.ids = np.concatenate([self.ids, symbol])

    def encode(self, texts: list[str | None], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their counts, with begin and end ids if ``ends``."""
        # A space before each text, so that every word begins with one.
        spaced = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        raw = "".join(spaced).encode("utf-8", "surrogatepass")
        spaces = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 0x20)
        met, which = distinct(raw, np.append(spaces, len(raw)))
        words = [w[1:].decode("utf-8", "surrogatepass") for w in met]
        if len(self.words) > KEPT_WORDS:
            self._forget()
        unknown = [w for w in words if w not in self.words]
        if unknown:
            self._learn(unknown)
        items = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))[which]
        sizes = np.array([t.count(" ") for t in spaced], dtype=np.int64)
        ends_at = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        full = items > 0
        # Spaces pile up before an item with a core, or at the end of a text.
        lone = self.lone[items].astype(np.int64)
        stop = full.copy()
        stop[ends_at[sizes > 0] - 1] = True
        total = np.cumsum(lone)
        stops = np.flatnonzero(stop)
        run = np.diff(np.concatenate([[0], total[stops]])) if len(stops) else np.zeros(0, np.int64)
        whole, rest = run // self.run, run % self.run
        item, who = items[stops], owner[stops]
        # Per stop: the long runs, the rest of the run, the core.
        width = whole + self.rest_count[rest] + self.count[item]
        counts = np.bincount(who, weights=width, minlength=len(texts)).astype(np.int64) + 2 * ends
        out = np.empty(int(counts.sum()), dtype=np.int64)
        text_at = np.cumsum(counts) - counts
        before = np.cumsum(width) - width
        at = before + (2 * who + 1) * ends  # the ends of earlier texts and the own begin id
        if whole.any():
            out[_ranges(at, whole)] = self.run_id
        out[_ranges(at + whole, self.rest_count[rest])] = self.rest_id[_ranges(self.rest_at[rest], self.rest_count[rest])]
        out[_ranges(at + width - self.count[item], self.count[item])] = self.ids[_ranges(self.start[item], self.count[item])]
        if ends:
            out[text_at], out[text_at + counts - 1] = self.bos, self.eos
        return out, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of flat ids; begin and end ids vanish, and so does the first space of a text."""
        sizes = self.text_size[ids]
        flat = self.text_flat[_ranges(self.text_at[ids], sizes)]
        owner = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64))
        written = np.flatnonzero(sizes > 0)
        first = np.zeros(len(counts), dtype=bool)
        if len(written):
            who = owner[written]
            lead = np.concatenate([[True], who[1:] != who[:-1]])
            first[who[lead]] = self.spaced[ids[written[lead]]]
        raw, out, begin = flat.tobytes(), [], 0
        id_ends = np.cumsum(counts)
        inner = np.ones(len(ids), dtype=bool)
        inner[id_ends[counts > 0] - 1] = inner[(id_ends - counts)[counts > 0]] = False
        parted = np.bincount(owner[inner & (sizes == 0)], minlength=len(counts)) > 0  # control ids may part two bytes
        for k, end in enumerate(ends.tolist()):
            whole = None if parted[k] else _utf8(raw[begin + int(first[k]):end])
            if whole is None:
                whole = self._broken(ids[id_ends[k] - counts[k]:id_ends[k]])[int(first[k]):]
            out.append(whole)
            begin = end
        return out

    def _broken(self, ids: np.ndarray) -> str:
        """Byte pieces that are no UTF-8: each byte that starts no whole character is U+FFFD."""
        out = []
        for is_byte, group in itertools.groupby(ids.tolist(), key=lambda i: bool(self.is_byte[i])):
            raw = b"".join(self.text[i] for i in group)
            while raw:
                if not is_byte:
                    out.append(raw.decode())
                    break
                width, char = next(((w, c) for w in (1, 2, 3, 4) if (c := _utf8(raw[:w])) is not None), (1, "�"))
                out.append(char)
                raw = raw[width:]
        return "".join(out)


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … count[0] of them, then those of start[1], and so on."""
    total = int(count.sum())
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return shift + np.arange(total)


_LOADED: dict[int, Pieces] = {}


def _loaded(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _with_columns(df: DataFrame, columns: list[T.StructField], over: str, make) -> DataFrame:
    """Each row with new columns at its end; columns of the same names are replaced."""
    bounded_batches(reachable(df.sparkSession), BATCH)
    names = {c.name.lower() for c in columns}
    kept = [f for f in df.schema.fields if f.name.lower() not in names or f.name == over]
    schema = T.StructType([f for f in kept if f.name.lower() not in names] + columns)
    arrow = to_arrow_schema(schema)
    carried = [f.name for f in kept if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch, over, PART):
                part = batch.slice(begin, end - begin)
                made = make(part.column(over))
                fresh = [a.cast(arrow.field(c.name).type) for c, a in zip(columns, made, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c).cast(arrow.field(c).type) for c in carried] + fresh, schema=arrow)

    return df.select(*(f.name for f in kept)).mapInArrow(run, schema)


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw = ids.astype("<u4").tobytes()
    offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def round_trip(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded", ends: bool = True) -> DataFrame:
    """Each row with its ids (little-endian unsigned 32-bit integers in one binary) and the text they decode to, in one pass.

    Null and empty texts get only begin and end ids and the empty text. Repeated rows repeat; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        pieces = _loaded(shared.value)
        flat, counts = pieces.encode(texts.to_pylist(), ends)
        return [_packed(flat, counts), pa.array(pieces.decode(flat, counts), type=pa.string())]

    return _with_columns(df, [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())], text, make)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", ends: bool = True) -> DataFrame:
    """Each row with its ids as ``array<int>``; see ``round_trip`` for nulls and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        flat, counts = _loaded(shared.value).encode(texts.to_pylist(), ends)
        return [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat.astype(np.int32)))]

    return _with_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], text, make)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Each row with the text of its ids, given packed or as ``array<int>``; null ids, and ids that are null, give nothing."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)

    def make(column: pa.Array) -> list[pa.Array]:
        if packed:
            rows = [np.frombuffer(x or b"", dtype="<u4").astype(np.int64) for x in column.to_pylist()]
        else:
            rows = [np.array([i for i in x or () if i is not None], dtype=np.int64) for x in column.to_pylist()]
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)])
        return [pa.array(_loaded(shared.value).decode(flat, counts), type=pa.string())]

    return _with_columns(df, [T.StructField(text, T.StringType())], ids, make)
