"""Alignment of two tokenizers' tokens, and counts of the id pairs that meet.

Tokens of both sides lie on the same bytes. Every token points to its farthest-right overlapping token of the
other side, or to itself if none ends beyond it. Successors are doubled for all tokens of many documents at
once until nothing moves: each component's tokens then point to its terminal token, whose end both sides share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, documents, unused, written
from .lots import Numbered, lot_number
from .pieces import Encoder, default_model, sliced
from .token_pool import byte_strings, gathered, token_pool

#: Links and distinct pairs at which a lot is closed.
LOT_LINKS, LOT_PAIRS = 4_000_000, 500_000
_SIDE = 32
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: Marks between ids of the written groups: first of all, in a group, before a group, before its second side.
_MARKS = ("", ",", ";", "|")


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token on either side, the number of the terminal token of its component (among the second side's).

    The arguments are ascending ends of tokens that cover the same bytes without gaps.
    """
    n = len(a_end)
    of_a = n + np.searchsorted(b_end, a_end)  # the first token that ends at or after this one's end
    beyond = np.searchsorted(a_end, b_end)
    own = n + np.arange(len(b_end))
    of_b = np.where(a_end[beyond] > b_end, beyond, own) if len(b_end) else own
    successor = np.concatenate([of_a, of_b])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor[:n] - n, successor[n:] - n
        successor = farther


def linked(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (their numbers) whose bytes overlap, in order."""
    a_start = np.concatenate([[0], a_end[:-1]])
    first = np.searchsorted(b_end, a_start, side="right")
    counts = np.searchsorted(b_end, a_end) - first + 1
    ends = np.cumsum(counts)
    a = np.repeat(np.arange(len(a_end)), counts)
    return a, np.repeat(first - (ends - counts), counts) + np.arange(len(a))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Aligner:
    """Tokens of texts on both sides, where their joined bytes are those of a space and the text."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.pool, self.encoder = token_pool(bytes_path, "bytes", True), _encoder(pieces_path)
        strings, m = byte_strings(bytes_path), self.encoder.model
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.lens = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.at = np.cumsum(self.lens) - self.lens
        self.model = m
        most = max(len(strings), m.size)
        self.spelled = [f"{mark}{i}" for mark in _MARKS for i in range(most)]
        self.most = most

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts have tokens, then for these ids and counts of the first side and of the second."""
        given = [(" " + t).encode() if t else b"" for t in texts.to_pylist()]
        a, a_n = self.pool.encode(texts)
        b, b_n = self.encoder.encode([g[1:].decode() for g in given])
        size = np.fromiter(map(len, given), dtype=np.int64, count=len(given))
        ok = (size > 0) & self._same(given, size, self.data, self.at, self.lens, a, a_n)
        ok &= self._same(given, size, self.model.out, self.model.out_at, self.model.out_len, b, b_n)
        return ok, a[np.repeat(ok, a_n)], a_n[ok], b[np.repeat(ok, b_n)], b_n[ok]

    @staticmethod
    def _same(given: list[bytes], size: np.ndarray, data: np.ndarray, at: np.ndarray, lens: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        spelled = gathered(data, at[ids], lens[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(lens[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        same = np.diff(ends) == size
        for k in np.flatnonzero(same & (size > 0)).tolist():
            same[k] = spelled[ends[k] : ends[k + 1]] == given[k]
        return same

    def groups(self, a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Links (numbers of tokens on both sides), then of each document the groups' number and spelling."""
        a_end, b_end = np.cumsum(self.lens[a]), np.cumsum(self.model.out_len[b])
        of_a, of_b = terminals(a_end, b_end)
        number = np.cumsum(np.bincount(of_b, minlength=len(b)) > 0) - 1
        a_group, b_group = number[of_a], number[of_b]
        many = int(number[-1]) + 1 if len(number) else 0
        a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=many))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=many))])
        a_starts, b_starts = a_before[:-1], b_before[:-1]
        a_mark, b_mark = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        a_mark[a_starts], b_mark[b_starts] = 2, 3
        first = np.concatenate([[0], np.cumsum(a_n)])
        a_mark[first[:-1]] = 0
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + b_before[a_group]] = a_mark * self.most + a
        code[np.arange(len(b)) + a_before[b_group + 1]] = b_mark * self.most + b
        spelled = list(map(self.spelled.__getitem__, code.tolist()))
        ends = np.concatenate([[0], np.cumsum(a_n + b_n)]).tolist()
        texts = ["".join(spelled[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        n_groups = np.diff(np.searchsorted(a_starts, first))
        return (*linked(a_end, b_end), n_groups, texts)


class _Lot:
    """Pairs and their counts of the documents since the last lot was closed."""

    def __init__(self):
        self.place, self.count, self.links = Numbered(), np.zeros(0, np.int64), 0

    def add(self, pair: np.ndarray) -> np.ndarray:
        """The pairs' numbers in this lot."""
        distinct, where, counts = np.unique(pair, return_inverse=True, return_counts=True)
        local = np.fromiter(map(self.place.__getitem__, distinct.tolist()), dtype=np.int64, count=len(distinct))
        self.count = np.append(self.count, np.zeros(len(self.place) - len(self.count), np.int64))
        self.count[local] += counts
        self.links += len(pair)
        return local[where]


def _per_document(local: np.ndarray, document: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers of each document, flat, how often each comes, and how many a document has."""
    width = int(local.max()) + 1 if len(local) else 1
    key, times = np.unique(document * width + local, return_counts=True)
    return (key % width).astype(np.int32), times.astype(np.int32), np.bincount(key // width, minlength=n)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))


def align(docs: DataFrame, bytes_path: str, pieces_path: str, text_col: str = "text", groups_col: str | None = "groups", digest_col: str | None = None) -> DataFrame:
    """``docs`` without ``text_col``, with the alignment of each text's tokens by two vocabularies.

    The first side is the byte-level vocabulary over a space and the text, the second the pieces of the text.
    Adds longs ``n_a, n_b`` (tokens), ``n_groups`` (smallest byte ranges at whose ends both sides' tokens end),
    ``n_links`` (pairs of tokens whose bytes overlap), ``n_best`` (links whose id pair is linked as often in the
    corpus as the most frequent pair of its second id) and ``count_sum`` (of the links' corpus-wide counts);
    ``groups_col`` holds the groups as ``a1,a2|b1;a3|b2,b3`` and ``digest_col`` the SHA-256 of that.

    Null and empty texts, and texts that either side's tokens do not spell exactly, have no tokens: zeros and
    empty strings. Repeated rows each count. All rows and other columns pass, those with a name of a result are
    replaced; an empty table stays empty. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    strings = [c for c in (groups_col, digest_col) if c]
    results = [*_COUNTS, "n_best", "count_sum", *strings]
    names = [c for c in docs.columns if c not in {*results, text_col}]
    lot, numbers, times, pairs, counts = (unused(docs, f"__{c}") for c in ("lot", "numbers", "times", "pairs", "counts"))
    long = F.lit(0).cast("long")
    shape = docs.select(*names, *[long.alias(c) for c in _COUNTS], *[F.lit("").alias(c) for c in strings], long.alias(lot))
    shape = shape.select("*", *[F.array(F.lit(0)).alias(c) for c in (numbers, times)], *[F.array(long).alias(c) for c in (pairs, counts)])
    schema = StructType([StructField(f.name, f.dataType, True) for f in shape.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, now, made, like = Aligner(bytes_path, pieces_path), _Lot(), 0, None

        def closed() -> pa.RecordBatch:
            own = {lot: [lot_number(made)], pairs: [list(now.place)], counts: [now.count.tolist()]}
            return pa.RecordBatch.from_arrays([pa.array(own.get(f.name, [None]), f.type) for f in like], schema=like)

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for x, y in sliced(column):
                ok, a, a_n, b, b_n = aligner.tokens(column.slice(x, y - x).fill_null(""))
                a_of, b_of, n_groups, texts = aligner.groups(a, a_n, b, b_n)
                document = np.repeat(np.flatnonzero(ok), a_n)[a_of]
                found, often, per = _per_document(now.add(a[a_of].astype(np.int64) << _SIDE | b[b_of]), document, len(ok))
                sums = np.zeros((4, len(ok)), dtype=np.int64)
                sums[:3, ok] = a_n, b_n, n_groups
                sums[3] = np.bincount(document, minlength=len(ok))
                spelled = np.full(len(ok), "", dtype=object)
                spelled[ok] = texts
                strings_of = {digest_col: [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in spelled]} if digest_col else {}
                columns = [*batch.slice(x, y - x).select(names).columns, *map(pa.array, sums)]
                columns += [pa.array(strings_of.get(c, spelled), pa.string()) for c in strings]
                none = pa.nulls(len(ok), pa.list_(pa.int64()))
                columns += [pa.array(np.full(len(ok), lot_number(made))), _lists(found, per), _lists(often, per), none, none]
                out = pa.RecordBatch.from_arrays(columns, names=schema.names)
                like = out.schema
                yield out
                if now.links >= LOT_LINKS or len(now.place) >= LOT_PAIRS:
                    yield closed()
                    now, made = _Lot(), made + 1
        if now.place:
            yield closed()

    aligned = written(docs.mapInArrow(run, schema), "aligned").read()
    listed = aligned.where(F.col(pairs).isNotNull()).select(F.col(lot).alias("lot"), F.posexplode(F.arrays_zip(F.col(pairs).alias("pair"), F.col(counts).alias("n"))).alias("number", "x"))
    listed = listed.select("lot", "number", "x.pair", "x.n")
    facts = _facts(listed)
    left = aligned.where(F.col(pairs).isNull()).drop(pairs, counts)
    wanted = [*names, *_COUNTS, "n_best", "count_sum", *strings]
    end = StructType([StructField(c, left.schema[c].dataType if c in left.columns else LongType(), True) for c in wanted])

    def resolve(documents_of: pa.Table, facts_of: pa.Table) -> pa.Table:
        at = facts_of.column("number").to_numpy()
        total, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        total[at], best[at] = facts_of.column("total").to_numpy(), facts_of.column("best").to_numpy()
        column = documents_of.column(numbers).combine_chunks()
        where, often = column.flatten().to_numpy(), documents_of.column(times).combine_chunks().flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        made = {"count_sum": total[where] * often, "n_best": np.where(total[where] == best[where], often, 0)}
        made = {c: np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for c, v in made.items()}
        return pa.table([pa.array(made[c]) if c in made else documents_of.column(c) for c in wanted], names=wanted)

    return left.groupBy(lot).cogroup(facts.groupBy("lot")).applyInArrow(resolve, end)


def _facts(listed: DataFrame) -> DataFrame:
    """``lot, number, total, best``: corpus-wide counts of a lot's pairs, and the highest of their second id."""
    totals = written(listed.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals").read()
    second = F.col("pair").bitwiseAND((1 << _SIDE) - 1)
    best = totals.groupBy(second.alias("b")).agg(F.max("total").alias("best"))
    totals = totals.withColumn("b", second).join(F.broadcast(best), "b").drop("b")  # as many rows as the vocabulary
    return listed.join(totals, "pair").select("lot", "number", "total", "best")


def default_bytes() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_alignment(spark, sf_dir: str, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return align(docs, bytes_path or default_bytes(), pieces_path or default_model(), groups_col=None, digest_col="groups_sha256")
