"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

The words of a batch become one flat numpy array of symbols. A round looks up the rank of every adjacent
pair, takes the minimum per word (a segmented reduction), merges its leftmost places in all words at once
and compacts the array; words in which no pair is left drop out. Every task keeps what it found for a word
in a bounded pool, so frequent words are merged once.

In a long word a round takes the minimum of every neighbourhood instead. No piece is longer than K characters,
so what happens more than K symbols away cannot reach a pair before its turn: all pairs that are the least
within K places merge in one round, and the number of rounds hardly grows with the word.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents

#: Characters of text that are encoded at once.
SLICE_CHARS = 1 << 19
#: Words that a task remembers before it starts afresh.
POOL_WORDS = 150_000
#: Words with more characters are merged by neighbourhoods.
LONG_WORD = 64
_NONE = np.int32(2**31 - 1)
_APART = -(1 << 40)
_BLANK = "▁"
_UNKNOWN = " ⁇ "


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protobuf message: number, and bytes or an integer."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            n, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else number(at)
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """Vocabulary and pair ranks of a BPE ``.model`` file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, normalizer, trainer = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: 1} | dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only BPE models with the identity normalizer and a dummy prefix are supported")
        self.size = len(pieces)
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        scores = sorted({pieces[i][1] for i in ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        rank = {p: place[pieces[i][1]] for p, i in ids.items()}
        if any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(a != _BLANK and b == _BLANK for p in ids for a, b in zip(p, p[1:], strict=False)) or any("\n" in p and p != "\n" for p in ids):
            raise ValueError("a piece spans words")
        self.longest = max(map(len, ids), default=1)
        self.joined = {c for p in ids if len(p) > 1 for c in p}
        #: Symbols beyond the vocabulary: characters that only occur inside pieces.
        symbols = dict(ids)
        for c in sorted(self.joined - set(ids)):
            symbols[c] = self.size + len(symbols) - len(ids)
        self.chars = {c: i for c, i in symbols.items() if len(c) == 1}
        pairs = {}
        for p in ids:
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank[p], ids[p])
        merged_rank = np.full(len(symbols) + self.size, -1, dtype=np.int64)
        for p, i in ids.items():
            merged_rank[i] = rank[p]
        #: A piece is safe if every pair that it takes part in comes later than the piece itself: its places
        #: can then be merged in one round, as if one after another.
        self.safe = np.ones(len(merged_rank), dtype=bool)
        for (a, b), (r, _) in pairs.items():
            for x in (a, b):
                if merged_rank[x] >= r:
                    self.safe[x] = False
        self.pairs = {a << 32 | b: found for (a, b), found in pairs.items()}
        self._hash(pairs)
        self.bytes_from = next(i for i, (_, _, kind) in enumerate(pieces) if kind == 6)
        out = [b"" if kind == 3 else _UNKNOWN.encode() if kind == 2 else bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(_BLANK, " ").encode() for p, _, kind in pieces]
        self.out_len = np.array([len(x) for x in out], dtype=np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.begins_blank = np.array([p.startswith(_BLANK) for p, _, _ in pieces])

    def _hash(self, pairs: dict) -> None:
        """Open addressing, so that a lookup is a few gathers."""
        self.mask = (1 << max(4, int(len(pairs) * 8).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, dtype=np.int32)
        self.merged = np.zeros(self.mask + 1, dtype=np.int32)
        for (a, b), (r, i) in pairs.items():
            at = self._slot(a, b)
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.merged[at] = a << 32 | b, r, i

    def _slot(self, a, b):
        return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & self.mask

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the pairs in the table, or -1."""
        key = a << 32 | b
        at = self._slot(a, b)
        found = self.keys[at]
        out = np.where(found == key, at, -1)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _symbols(self, words: list[str]) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        distinct, where = np.unique(points, return_inverse=True)
        return np.array([self.chars.get(chr(c), -1 - int(c)) for c in distinct.tolist()], dtype=np.int64)[where]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, flat, and each word's count. Unknown characters are negative."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        longs = np.flatnonzero(size > LONG_WORD)
        if not len(longs):
            return self._merge_words(words)
        shorts = np.flatnonzero(size <= LONG_WORD)
        found = [self._merge_words([words[k] for k in shorts]), self._merge_long([words[k] for k in longs])]
        owner = np.concatenate([np.repeat(which, counts) for which, (_, counts) in zip((shorts, longs), found, strict=True)])
        sym = np.concatenate([x for x, _ in found])
        return sym[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        sym = self._symbols(words)
        seg = np.repeat(np.arange(n), np.fromiter(map(len, words), dtype=np.int64, count=n))
        done_sym, done_seg = [], []

        def ranks(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and table slot of the pair that starts at each place of ``left``."""
            a, b = sym[left], sym[np.minimum(left + 1, len(sym) - 1)]
            ok = (left + 1 < len(sym)) & (a >= 0) & (b >= 0)
            ok[ok] = seg[left[ok]] == seg[left[ok] + 1]
            at = np.full(len(left), -1, dtype=np.int64)
            at[ok] = self.lookup(a[ok], b[ok])
            return np.where(at >= 0, self.ranks[at], _NONE), at

        rank, slot = ranks(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(sym)))
            over = least == _NONE
            if over.any():
                out = np.repeat(over, counts)
                done_sym.append(sym[out])
                done_seg.append(seg[out])
                sym, seg, rank, slot = sym[~out], seg[~out], rank[~out], slot[~out]
                if not len(sym):
                    break
                least, counts = least[~over], counts[~over]
            hit = np.flatnonzero(rank == np.repeat(least, counts))
            new_word = np.concatenate([[True], seg[hit[1:]] != seg[hit[:-1]]])
            run = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | new_word[1:]])
            in_run = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            take = new_word | (self.safe[self.merged[slot[hit]]] & (in_run % 2 == 0))
            if not self.safe[self.merged[slot[hit]]].all():
                unsafe = np.zeros(int(seg[-1]) + 1, dtype=bool)
                unsafe[seg[hit[~self.safe[self.merged[slot[hit]]]]]] = True
                take &= new_word | ~unsafe[seg[hit]]
            hit = hit[take]
            sym[hit] = self.merged[slot[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, seg, rank, slot = sym[keep], seg[keep], rank[keep], slot[keep]
            changed = np.unique(np.concatenate([place[hit], np.maximum(place[hit] - 1, 0)]))
            rank[changed], slot[changed] = ranks(changed)
        if not done_sym:
            return np.zeros(0, dtype=np.int64), np.zeros(n, dtype=np.int64)
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        sym = sym[np.argsort(seg, kind="stable")]
        return sym, np.bincount(seg, minlength=n)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and table slot of pairs; no symbol that is negative has any."""
        at = np.full(len(a), -1, dtype=np.int64)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        at[ok] = self.lookup(a[ok], b[ok])
        return np.where(at >= 0, self.ranks[at], _NONE), at

    def _merge_long(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, by neighbourhoods. Words lie one after another, with a symbol between that joins nothing.

        A pair merges if none of a lower rank starts within ``longest`` places. Of pairs of the same rank the
        left one comes first; they merge in one round too if none gives rise to a pair that ranks before it.
        """
        sizes = [len(w) for w in words]
        sym = np.insert(self._symbols(words), np.cumsum(sizes)[:-1], _APART)
        near = self.longest - 1
        rank, slot = self._ranks(sym[:-1], sym[1:])
        while len(live := np.flatnonzero(rank != _NONE)):
            least = rank == _nearby_min(rank, near)
            place = np.arange(len(rank))
            first = np.ones(len(rank), dtype=bool)
            first[1:] = rank[1:] != rank[:-1]
            run = np.maximum.accumulate(np.where(first, place, 0))
            waits = np.maximum.accumulate(np.where((rank != _NONE) & ~least, place, -1))
            take = least & (rank != _NONE) & (waits < run) & ((place - run) % 2 == 0)
            hit = np.flatnonzero(take)
            made = self.merged[slot[hit]].astype(np.int64)
            loud = self._loud(sym, rank, take, hit, made)
            swept: list[tuple[int, int, list[int]]] = []
            if len(odd := np.flatnonzero(~self.safe[made])):
                self._order_equals(sym, rank, live, least, take, hit[odd], hit[loud], swept)
            hit = np.flatnonzero(take)
            sym[hit] = self.merged[slot[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            for a, b, symbols in swept:
                sym[a : a + len(symbols)] = symbols
                keep[a + len(symbols) : b] = False
            sym = sym[keep]
            rank, slot = self._ranks(sym[:-1], sym[1:])
        owner = np.cumsum(sym == _APART)
        real = sym != _APART
        return sym[real], np.bincount(owner[real], minlength=len(words))

    def _loud(self, sym: np.ndarray, rank: np.ndarray, take: np.ndarray, hit: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which hits give rise to a pair that ranks before their own, or equal to it: then it is further to the left."""
        odd = np.flatnonzero(~self.safe[made])
        at, m = hit[odd], made[odd]
        padded = np.concatenate([[_APART], sym, [_APART, _APART]])
        beside = np.concatenate([[False, False], take, [False, False, False]])
        next_too = beside[at] | beside[at + 4]  # a hit two places off becomes a neighbour
        born = np.minimum(self._ranks(padded[at], m)[0], self._ranks(m, padded[at + 3])[0])
        born = np.where(next_too, np.minimum(born, self._ranks(m, m)[0]), born)
        return odd[born <= rank[at]]

    def _order_equals(self, sym: np.ndarray, rank: np.ndarray, live: np.ndarray, least: np.ndarray, take: np.ndarray, hits: np.ndarray, loud: np.ndarray, swept: list) -> None:
        """Puts off hits (in ``take``) that an equal pair to their left may reach first.

        Equal pairs less than two ``longest`` places apart are a group, so what arises in two groups never meets. All before the first one that
        waits or is loud may merge, and that one if it is loud. A group with nothing near that ranks before it
        is merged one after another instead, with all that arises, and goes to ``swept``.
        """
        wanted = np.zeros(int(rank[hits].max()) + 1, dtype=bool)
        wanted[rank[hits]] = True
        some = live[rank[live] < len(wanted)]
        some = some[wanted[rank[some]]]
        some = some[np.argsort(rank[some], kind="stable")]
        start = np.flatnonzero(np.concatenate([[True], (rank[some[1:]] != rank[some[:-1]]) | (some[1:] - some[:-1] >= 2 * self.longest)]))
        noisy = np.zeros(len(rank), dtype=bool)
        noisy[loud] = True
        trouble = np.where(noisy[some] | ~least[some], np.arange(len(some)), len(some))
        stop = np.minimum.reduceat(trouble, start)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(some))))
        late = np.arange(len(some)) > stop[group]
        take[some[late]] = False
        far = None
        for g in np.flatnonzero(stop < len(some)).tolist():
            places = some[start[g] : start[g + 1] if g + 1 < len(start) else len(some)]
            if not noisy[some[stop[g]]]:
                continue
            far = rank == _nearby_min(rank, 2 * self.longest) if far is None else far
            clear = far[places]
            places = places[: len(places) if clear.all() else int(clear.argmin())]
            if len(places) and places[-1] >= some[stop[g]]:
                take[places] = False
                a, b = max(0, int(places[0]) - self.longest + 2), min(len(sym), int(places[-1]) + self.longest)
                swept.append((a, b, self._sweep(sym[a:b].tolist(), (places - a).tolist(), int(rank[places[0]]))))

    def _sweep(self, right: list[int], places: list[int], rank: int) -> list[int]:
        """Merges equal pairs from left to right, after each one all that arises from it and ranks no later."""
        none = (_NONE, 0)
        left, at = [], 0
        for p in places:
            if p < at:
                continue
            left += right[at:p]
            made, at = self.pairs[right[p] << 32 | right[p + 1]][1], p + 2
            while True:
                before = self.pairs.get(left[-1] << 32 | made, none) if left and left[-1] >= 0 else none
                after = self.pairs.get(made << 32 | right[at], none) if at < len(right) and right[at] >= 0 else none
                if min(before[0], after[0]) > rank:
                    break
                if before[0] <= after[0]:
                    left.pop()
                    made = before[1]
                else:
                    at += 1
                    made = after[1]
            left.append(made)
        return left + right[at:]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and each word's count. Characters without a piece become their bytes."""
        sym, counts = self.merge(words)
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(odd):
            back = {i: c for c, i in self.chars.items() if i >= self.size}
            spelled = [(chr(-1 - x) if x < 0 else back[x]).encode() for x in sym[odd].tolist()]
            width = np.ones(len(sym), dtype=np.int64)
            width[odd] = [len(x) for x in spelled]
            word = np.repeat(np.arange(len(words)), counts)
            counts = np.bincount(word, weights=width, minlength=len(words)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(width)[:-1]])
            sym = np.repeat(sym, width)
            spots = np.repeat(at[odd], width[odd]) + np.arange(width[odd].sum()) - np.repeat(np.cumsum(width[odd]) - width[odd], width[odd])
            sym[spots] = np.frombuffer(b"".join(spelled), dtype=np.uint8).astype(np.int64) + self.bytes_from
        return sym.astype(np.int32), counts


def _nearby_min(values: np.ndarray, reach: int) -> np.ndarray:
    """The least value within ``reach`` places of each, by doubling windows."""
    edge = np.full(reach, _NONE, dtype=values.dtype)
    out, have, want = np.concatenate([edge, values, edge]), 1, 2 * reach + 1
    while have < want:
        step = min(have, want - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


#: Blanks and what follows them; nothing merges across a blank's left side or with a line feed.
_WORDS = re.compile(f"{_BLANK}+[^{_BLANK}\n]*|[^{_BLANK}\n]+|\n")


class Encoder:
    """Encodes texts with one model, remembering words."""

    def __init__(self, path: str, pool_words: int = POOL_WORDS):
        self.model, self.pool_words = model(path), pool_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.model.word_ids(words)
        start = len(self.ids) + np.cumsum(counts) - counts
        self.known.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.ids, self.at, self.len = np.concatenate([self.ids, ids]), np.concatenate([self.at, start]), np.concatenate([self.len, counts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and each text's count."""
        per_text = [_WORDS.findall(_BLANK + t.replace(" ", _BLANK)) if t else [] for t in texts]
        words = [w for ws in per_text for w in ws]
        if len(self.known) > self.pool_words:
            self._clear()
        if new := sorted(set(words).difference(self.known)):
            self._learn(new)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        index = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        lens = self.len[index]
        ends = np.cumsum(lens)
        flat = self.ids[np.repeat(self.at[index] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        total = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in per_text])])
        return flat, np.diff(total[bounds])


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each-byte", _one_by_one)


def decode_ids(m: PieceModel, flat: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of consecutive id lists: pieces joined, blanks as spaces, without the dummy prefix."""
    if len(flat) and (flat.min() < 0 or flat.max() >= m.size):
        raise ValueError("an id is outside the vocabulary")
    lens = m.out_len[flat]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    data = m.out[np.repeat(m.out_at[flat] - (ends - lens), lens) + np.arange(total)].tobytes()
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.concatenate([[0], ends])[first].tolist()
    out = []
    for k in range(len(counts)):
        a = at[k]
        if counts[k] and m.begins_blank[flat[first[k]]]:
            a += 1
        out.append(data[a : at[k + 1]].decode("utf-8", "each-byte"))
    return out


def sliced(column: pa.Array, size: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``size`` bytes, so that few texts are Python objects at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield start, stop
        start = stop


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text_col`` in ``ids_col`` (array of int; replaces such a column).

    With ``decoded_col``, the ids are decoded again in the same pass. Null counts as empty, and an empty text
    has no ids. Long texts are encoded whole. All other columns and all rows pass unchanged, repeated rows too.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    schema = docs.select(*names).withColumn(ids_col, F.array(F.lit(0)))
    schema = (schema if decoded_col is None else schema.withColumn(decoded_col, F.lit(""))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for a, b in sliced(column):
                flat, counts = encoder.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                made = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
                if decoded_col is not None:
                    made.append(pa.array(decode_ids(encoder.model, flat, counts), pa.string()))
                part = batch.slice(a, b - a).select(names)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in ``text_col``. Null or empty lists give an empty text."""
    bounded_batches(encoded.sparkSession)
    names = [c for c in encoded.columns if c != text_col]
    schema = encoded.select(*names).withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            start = 0
            while start < len(counts):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_CHARS)))
                a, b = int(ends[start] - counts[start]), int(ends[stop - 1])
                texts = decode_ids(m, flat[a:b], counts[start:stop])
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).select(names).columns, pa.array(texts, pa.string())], names=[*names, text_col])
                start = stop

    return encoded.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode(docs, model_path or default_model(), decoded_col="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
