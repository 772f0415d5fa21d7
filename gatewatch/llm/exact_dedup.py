"""Exact dedup with a cuckoo-filter index.

Every text is reduced to the SHA-256 of its normalised form in the JVM. The digests then meet a
:class:`CuckooIndex` twice: once in the task that read the rows, which leaves one row for each digest and
task (so a text that a third of all rows share is cheap to shuffle), and once in the bucket that owns the
digest. The filter answers "surely new" or "maybe known"; a maybe is verified against the 256-bit digests
that the bucket keeps beside it (texts themselves are not compared again). A better copy replaces the live one: the old entry is deleted from the filter and the new one
inserted. An insertion that finds no place doubles the filter and re-inserts all stored keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, picked, row_key, shuffle_partitions, unused, written

#: Live digests at which a reading task hands its index on and starts an empty one.
READING_KEYS = 200_000
#: Digests that the index of one bucket holds on average at most.
BUCKET_KEYS = 500_000
_SLOTS = 4
_KICKS = 256
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over a store of the live keys of its bucket.

    ``insert``, ``find`` and ``delete`` take a digest (bytes). The same fingerprint may be present several
    times, so deletion of one live digest never hides another. ``resizes`` counts how often the filter grew.
    """

    def __init__(self, capacity: int = 64, slots: int = _SLOTS):
        self.slots = slots
        self.live: dict[bytes, tuple] = {}
        self.resizes = self.false_hits = 0
        self._make(capacity)

    def _make(self, capacity: int) -> None:
        self.n = 1
        while self.n * self.slots * 0.9 < capacity:
            self.n *= 2
        self.table = np.zeros((self.n, self.slots), dtype=np.uint16).tolist()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = _mix(int.from_bytes(key[:8], "little") ^ len(key))
        tag = (h >> 48) or 1
        first = h & (self.n - 1)
        return tag, first, self._other(first, tag)

    def _other(self, place: int, tag: int) -> int:
        return (place ^ _mix(tag)) & (self.n - 1)

    def _maybe(self, key: bytes) -> bool:
        tag, a, b = self._places(key)
        return tag in self.table[a] or tag in self.table[b]

    def _put(self, key: bytes) -> bool:
        tag, a, b = self._places(key)
        for place in (a, b):
            row = self.table[place]
            if 0 in row:
                row[row.index(0)] = tag
                return True
        place = b
        for kick in range(_KICKS):
            row = self.table[place]
            k = (kick * 7 + tag) % self.slots
            row[k], tag = tag, row[k]
            place = self._other(place, tag)
            row = self.table[place]
            if 0 in row:
                row[row.index(0)] = tag
                return True
        return False  # a tag is in nobody's place now: the caller rebuilds from the stored keys

    def _rebuild(self) -> None:
        capacity = self.n * self.slots
        while True:
            capacity *= 2
            self.resizes += 1
            self._make(capacity)
            if all(self._put(k) for k in self.live):
                return

    def find(self, key: bytes):
        """The value of a live key, or None. A filter hit is verified against the stored keys."""
        if not self._maybe(key):
            return None
        found = self.live.get(key)
        self.false_hits += found is None
        return found

    def insert(self, key: bytes, value) -> None:
        if key in self.live:
            self.delete(key)
        self.live[key] = value
        if not self._put(key):
            self._rebuild()

    def delete(self, key: bytes) -> bool:
        if self.find(key) is None:
            return False
        tag, a, b = self._places(key)
        row = self.table[a] if tag in self.table[a] else self.table[b]
        row[row.index(tag)] = 0
        del self.live[key]
        return True


def _better(a: tuple, b: tuple) -> bool:
    """More code points first, then the smaller id; a null id comes last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


_PARTIAL = pa.schema([("digest", pa.binary()), ("n_points", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _drained(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    items = list(index.live.items())
    for at in range(0, len(items), 10_000):
        part = items[at : at + 10_000]
        columns = [[k for k, _ in part], *([v[i] for _, v in part] for i in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTIAL, strict=True)], schema=_PARTIAL)


def _read(batches: Iterator[pa.RecordBatch], most: int = READING_KEYS) -> Iterator[pa.RecordBatch]:
    """Partial groups of a reading task: its index never holds many more than ``most`` digests."""
    index = CuckooIndex()
    for batch in batches:
        _take(index, batch)
        if len(index.live) >= most:
            yield from _drained(index)
            index = CuckooIndex()
    yield from _drained(index)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of the bucket that owns the digests."""
    index = CuckooIndex()
    for batch in batches:
        _take(index, batch)
    yield from _drained(index)


def _take(index: CuckooIndex, batch: pa.RecordBatch) -> None:
    for key, points, doc, size in zip(*(batch.column(n).to_pylist() for n in _PARTIAL.names), strict=True):
        known = index.find(key)
        if known is None:
            index.insert(key, (points, doc, size))
        elif _better((points, doc), known):
            index.delete(key)
            index.insert(key, (points, doc, known[2] + size))
        else:
            index.live[key] = (known[0], known[1], known[2] + size)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space; of equal texts the one with the most code points,
    then the smallest id, stays. A null text counts as empty. Rows with the same id and the same text are
    one group; of rows that repeat the kept row exactly, all say ``kept`` (use :func:`deduplicated` to drop
    the repeats too). A null id ranks behind every other. Empty tables give empty results; other columns,
    whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        F.unhex(F.sha2(F.translate(text, SPACE, "").cast("binary"), 256)).alias("digest"),
    )
    keyed = written(keyed, "exact-keys").read()
    kind = "digest binary, n_points bigint, keep_id bigint, group_size bigint"
    local = keyed.select("digest", "n_points", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(_read, kind)
    buckets = max(shuffle_partitions(docs.sparkSession), math.ceil(keyed.count() / BUCKET_KEYS))
    groups = local.repartition(buckets, "digest").mapInArrow(_grouped, kind).select("digest", "keep_id", "group_size")
    joined = keyed.select("doc_id", "digest").join(groups, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: one of each group of equal texts.

    Of rows that share the kept row's id and differ in white space or other columns, the longest text stays,
    then one chosen by a hash of the whole row; of rows that agree in everything, one. A null id is matched like
    any other value, null texts are empty ones, and columns of any name pass.
    """
    found = exact_dedup(docs, id_col, text_col).where("kept")
    kept = written(found.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).agg(F.count("*").alias("__copies")), "exact-kept").read()
    text, digest = F.coalesce(F.col(text_col), F.lit("")), unused(docs, "__text_digest")
    rows = docs.withColumn(digest, F.sha2(F.translate(text, SPACE, "").cast("binary"), 256))
    same = lambda left, right: left[id_col].cast("long").eqNullSafe(right["__id"]) & (left[digest] == right["__digest"])
    single, several = kept.where("__copies = 1"), kept.where("__copies > 1")
    out = rows.join(single, same(rows, single), "left_semi").drop(digest)
    if not several.limit(1).count():
        return out
    # several rows with the kept id and digest: one of them stays. They are compared by keys of fixed width.
    row = unused(rows, "__row")
    keyed = rows.withColumn(row, row_key(docs))
    best = F.max(F.struct(F.length(text).alias("n"), F.col(row).alias("row"), F.lit(2).alias("copies")))
    chosen = keyed.groupBy(F.col(id_col).cast("long").alias("i"), F.col(digest).alias("d")).agg(best.alias("b"))
    chosen = chosen.join(several, chosen["i"].eqNullSafe(several["__id"]) & (chosen["d"] == several["__digest"]), "left_semi")
    chosen = written(chosen.select(F.col("b.row").alias(row), "b.copies"), "exact-chosen").read()
    return out.unionByName(picked(keyed, chosen, row).select(*docs.columns))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id
  FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_dedup(documents(spark, sf_dir))
