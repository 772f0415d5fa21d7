"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes proposes cuts; a proposal stands if none came shortly before it,
and long gaps are cut at a fixed size. Cuts thus depend on nearby content only, and an insertion shifts no
chunk but those around it. Chunks are compared by a 128-bit digest: of the chunks that occur several times,
in different documents or in one, the first occurrence (smallest id, then place) is kept, all others are
repeats. Contiguous repeated chunks form passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bit_table import bit_table, held_in
from .common import Table, bounded_batches, documents, shuffle_partitions, text_buckets, unused, written
from .shingles import SLICE_BYTES, mixed

#: Bytes that the rolling hash sees.
SEEN = 16
#: One place in so many is proposed as a cut.
RARITY = 16
#: Least and largest bytes of a chunk (the last one of a text may be shorter).
LEAST = 10
LARGEST = 256
#: Characters from which a repeated passage counts. The chunks at its ends take in what stands around it, so a
#: run of shared chunks is some 65 bytes shorter; shorter runs are therefore extended by what stands beside them.
PASSAGE_CHARS = 120
#: Bytes beside a chunk that are compared, from the smallest on.
BESIDE = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128)
_BASE = 0x9E3779B97F4A7C15 | 1
_GEAR = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk begins and ends of the texts ``data[starts:ends]``, in order; texts lie ``SEEN`` zeros apart."""
    h = _GEAR[data]
    h[data == 0] = 0
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # now the last 2 * k bytes
    starts, ends = starts[ends > starts], ends[ends > starts]
    if not len(starts):
        return starts, ends
    proposed = np.flatnonzero(((h & np.uint32(0xFFFF)) < np.uint32(65536 // RARITY))[:-1] & ((data[1:] & 0xC0) != 0x80)) + 1
    owner = np.searchsorted(starts, proposed, side="right") - 1
    inside = (owner >= 0) & (proposed < ends[owner])
    proposed, owner = proposed[inside], owner[inside]
    before = np.concatenate([[-LEAST], proposed[:-1]])
    stands = (proposed - before >= LEAST) & (proposed - starts[owner] >= LEAST)
    bounds = np.unique(np.concatenate([starts, proposed[stands], ends]))
    gap = np.diff(bounds)
    whole = np.searchsorted(starts, bounds[:-1], side="right") - 1
    real = bounds[:-1] < ends[whole]
    begin, size = bounds[:-1][real], gap[real]
    parts = -(-size // LARGEST)
    if (parts > 1).any():
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(begin + size, parts)
        begin = np.repeat(begin, parts) + nth * LARGEST
        inner = nth > 0
        for _ in range(3):  # not inside a character
            begin[inner] += (data[begin[inner]] & 0xC0) == 0x80
        begin = begin[begin < stop]
    end = np.append(begin[1:], 0)
    last = np.append(np.searchsorted(starts, begin[1:], side="right") != np.searchsorted(starts, begin[:-1], side="right"), True)
    end[last] = ends[np.searchsorted(starts, begin[last], side="right") - 1]
    return begin, end


class Chunks:
    """Chunks of texts: ``owner`` (the text's number), ``start`` and ``size`` in characters, ``digest`` (two 64-bit numbers)."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        gap = b"\0" * SEEN
        joined = gap + gap.join(raw) + gap
        self.data = np.frombuffer(joined, dtype=np.uint8)
        self.starts = SEEN + np.concatenate([[0], np.cumsum(sizes + SEEN)[:-1]]) if len(raw) else np.zeros(0, np.int64)
        self.ends = self.starts + sizes
        self.begin, self.end = cuts(self.data, self.starts, self.ends)
        digest = xxhash.xxh3_128_digest
        self.digest = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
        self.chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        # empty texts share a start with nothing: the last start up to the place is the text's own
        self.owner = np.searchsorted(self.starts, self.begin, side="right") - 1
        if len(self.begin):
            self.start, self.size = self.chars[self.begin] - self.chars[self.starts[self.owner]], self.chars[self.end] - self.chars[self.begin]
        else:
            self.start = self.size = self.begin

    def beside(self, some: np.ndarray, left: bool) -> list[bytes]:
        """Of some chunks: for each length in ``BESIDE`` on one side, a 32-bit hash, then the characters of each.

        A stretch that the text does not have has no characters.
        """
        if not len(some):
            return []
        length = np.array(BESIDE)
        powers = np.full(len(self.data) + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        a = (self.begin[some, None] - length) if left else np.broadcast_to(self.end[some, None], (len(some), len(length)))
        b = np.broadcast_to(self.begin[some, None], a.shape) if left else a + length
        there = (a >= self.starts[self.owner[some], None]) & (b <= self.ends[self.owner[some], None])
        a, b = np.where(there, a, 0), np.where(there, b, 0)
        value = mixed((sums[b] - sums[a]) * powers[len(self.data) - a]) >> np.uint64(32)
        cut = 0 if left else 1  # a character counts if all of it is inside
        chars = (self.chars[b + cut] - self.chars[a + cut]).astype(np.uint8)
        return [row.tobytes() for row in np.concatenate([value.astype("<u4").view(np.uint8).reshape(len(some), -1), chars], axis=1)]


def in_common(mine: bytes, other: bytes) -> int:
    """Characters beside two equal chunks that agree, by the longest of the compared lengths up to which all agree."""
    n, found = len(BESIDE), 0
    for k in range(n):
        chars = mine[4 * n + k]
        if mine[4 * k : 4 * k + 4] != other[4 * k : 4 * k + 4] or not chars or not other[4 * n + k]:
            break
        found = chars
    return found


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers and texts of rows (columns ``row, text``), about ``SLICE_BYTES`` at once."""
    rows, texts = batch.column(0).to_numpy(), [t or "" for t in batch.column(1).to_pylist()]
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < SLICE_BYTES):
            size += len(texts[stop])
            stop += 1
        yield rows[at:stop], texts[at:stop]
        at = stop


def _per_digest(columns: list[np.ndarray]) -> list[np.ndarray]:
    """One entry for each digest: its first row, its first place there, and its last row.

    Places are doubled; an odd one says that a row has the digest several times.
    """
    hi, lo, first, place, last = columns
    if not len(hi):
        return columns
    order = np.lexsort((place, first, lo, hi))
    hi, lo, first, place, last = (c[order] for c in columns)
    same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
    again = np.zeros(len(hi), dtype=np.int64)
    again[1:] = same & (first[1:] == first[:-1])
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    several = np.maximum.reduceat(again | place & 1, new)
    return [hi[new], lo[new], first[new], place[new] & ~1 | several, np.maximum.reduceat(last, new)]


def _packed(buckets: int):
    """The distinct chunks of a task, packed by bucket of their digest."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        columns = _per_digest([np.concatenate(c) for c in zip(*held, strict=True)])
        bucket = (columns[0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        columns, bucket = [c[order] for c in columns], bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(bucket)], strict=False):
            yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([np.stack([c[a:b] for c in columns]).tobytes()], pa.binary())], names=["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for rows, texts in _sliced(batch):
                found = Chunks(texts)
                held.append([found.digest[:, 0], found.digest[:, 1], rows[found.owner], found.start * 2, rows[found.owner]])
                waiting += len(found.owner)
                if waiting > 1_000_000:
                    yield from flush(held)
                    held, waiting = [], 0
        yield from flush(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a bucket: the digests that occur several times, with their first occurrence."""
    held = [np.frombuffer(p, np.int64).reshape(5, -1) for batch in batches for p in batch.column(1).to_pylist()]
    hi, lo, first, place, last = _per_digest(list(np.concatenate(held, axis=1))) if held else [np.zeros(0, np.int64)] * 5
    several = (first != last) | (place & 1 == 1)
    columns = [c[several] for c in (hi, lo, first, place >> 1, first == last)]
    for a in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=["hi", "lo", "first_row", "first_start", "inside"])


def shared_chunks(rows: DataFrame) -> Table:
    """``hi, lo, first_row, first_start, inside`` of the chunks of ``row, text`` that occur several times.

    ``inside``: in one row only. A chunk that all texts have is one entry for each reading task.
    """
    buckets = text_buckets(rows, "text")
    packed = rows.select("row", "text").mapInArrow(_packed(buckets), "bucket int, payload binary")
    kind = "hi bigint, lo bigint, first_row bigint, first_start bigint, inside boolean"
    return written(packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared, kind), "shared-chunks")


def occurrences(rows: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """``row, start, n_chars, hi, lo, left, right`` of the chunks of ``row, text`` whose digest is (but for few) in ``shared``.

    ``left`` and ``right`` are what stands beside a chunk where its neighbour there is not shared, else null.
    """
    marks = [bit_table(shared.select(F.col(c).alias("mark")), n) for c in ("hi", "lo")]
    tables = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _sliced(batch):
                found = Chunks(texts)
                held = held_in(tables.value[0], found.digest[:, 0]) & held_in(tables.value[1], found.digest[:, 1])
                goes_on = held[1:] & held[:-1] & (found.owner[1:] == found.owner[:-1])
                sides = []
                for left in (True, False):
                    open_ = np.flatnonzero(held & ~(np.append(False, goes_on) if left else np.append(goes_on, False)))
                    beside = np.full(len(held), None, dtype=object)
                    beside[open_] = found.beside(open_, left)
                    sides.append(beside)
                some = np.flatnonzero(held)
                for a in range(0, len(some), 20_000):
                    s = some[a : a + 20_000]
                    columns = [rows[found.owner[s]], found.start[s].astype(np.int64), found.size[s].astype(np.int64), found.digest[s, 0], found.digest[s, 1]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(x[s], pa.binary()) for x in sides)], names=["row", "start", "n_chars", "hi", "lo", "left", "right"])

    return rows.select("row", "text").mapInArrow(run, "row bigint, start bigint, n_chars bigint, hi bigint, lo bigint, left binary, right binary")


def _compared(pairs: DataFrame) -> DataFrame:
    """``row, run, left_side, more`` of pairs ``row, run, left_side, mine, other``: characters that both have beside a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = (batch.column(k).to_pylist() for k in (3, 4))
            more = [in_common(m, o) for m, o in zip(mine, other, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(more, pa.int64())], names=["row", "run", "left_side", "more"])

    return pairs.select("row", "run", "left_side", "mine", "other").mapInArrow(run, "row bigint, run bigint, left_side boolean, more bigint")


def _paired(ends: DataFrame, found: DataFrame) -> DataFrame:
    """``ends`` with ``other``: what stands there beside the first occurrence of its chunk, or beside all others for the first.

    Each digest has one kept occurrence. Two joins, each with the kept one on a side of its own, so a chunk that occurs n
    times gives some n pairs, where one join would try n * n.
    """
    beside = F.explode(F.array(*[F.struct(F.lit(side == "left").alias("left_side"), F.col(side).alias("other")) for side in ("left", "right")]))
    others = found.where("left IS NOT NULL OR right IS NOT NULL").select("hi", "lo", "kept", beside.alias("b")).select("hi", "lo", "kept", "b.*").where("other IS NOT NULL")
    first, later = others.where("kept").drop("kept"), others.where("NOT kept").drop("kept").distinct()
    place = ["hi", "lo", "left_side"]
    return ends.where("NOT kept").join(first, place).unionByName(ends.where("kept").join(later, place))


def _extended(found: DataFrame, short: DataFrame) -> DataFrame:
    """``row, run, to_left, to_right``: by how many characters short runs go on, compared with other occurrences.

    A run that is not kept is compared, at either end, with the first occurrence of its chunk there; a kept one
    with all others of that chunk, of which the farthest counts. Only occurrences whose neighbour on that side is not
    shared itself have anything to compare.
    """
    ends = found.join(short.select("row", "run", "run_start", "run_last"), ["row", "run"])
    side = F.explode(F.filter(F.array(F.when(F.col("start") == F.col("run_start"), F.lit(True)), F.when(F.col("start") == F.col("run_last"), F.lit(False))), lambda x: x.isNotNull()))
    on_side = F.when(F.col("left_side"), F.col("left")).otherwise(F.col("right"))
    ends = ends.select("row", "run", "kept", "hi", "lo", "left", "right", side.alias("left_side"))
    ends = written(ends.select("row", "run", "kept", "hi", "lo", "left_side", on_side.alias("mine")).where("mine IS NOT NULL"), "run-ends").read()
    pairs = _paired(ends, found)
    farthest = _compared(pairs).groupBy("row", "run", "left_side").agg(F.max("more").alias("more"))
    to = lambda side: F.max(F.when(F.col("left_side") == side, F.col("more")))
    return farthest.groupBy("row", "run").agg(to(True).alias("to_left"), to(False).alias("to_right"))


def _apart(runs: DataFrame) -> DataFrame:
    """Runs whose extensions do not reach into each other: what lies between two belongs to the first, as far as it goes."""
    in_row = Window.partitionBy("row").orderBy("run_start")
    end = F.col("run_start") + F.col("total")
    runs = runs.withColumn("to_right", F.least("to_right", F.coalesce(F.lead("run_start").over(in_row) - end, F.col("to_right"))))
    return runs.withColumn("to_left", F.least("to_left", F.coalesce(F.col("run_start") - F.lag(end + F.col("to_right")).over(in_row), F.col("to_left"))))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str = "row") -> tuple[DataFrame, bool]:
    """``docs`` with ``row_col``, a number that tells rows apart and orders them by id; and whether it differs from the id.

    It is the id itself, if none is null or repeated; only then is nothing written. Else null ids come last.
    """
    key, arrived = F.col(id_col).cast("long"), unused(docs, "__arrived")
    if not docs.groupBy(key.alias("i")).agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL").limit(1).count():
        return docs.withColumn(row_col, key), False
    order = [key.asc_nulls_last(), F.xxhash64(text_col), F.col(arrived)]
    dealt = docs.withColumn(arrived, F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.withColumn(row_col, F.monotonically_increasing_id()).drop(arrived), "numbered-rows").read(), True


def repeated_passages(docs: DataFrame, passage_chars: int = PASSAGE_CHARS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Passages that occur several times: ``doc_id, start, n_chars, kept, first_doc_id, inside, row``.

    ``start`` and ``n_chars`` are in characters. A run of adjacent repeated chunks of at least
    ``passage_chars`` is listed, also if it only gets there with what agrees beside its ends (up to 128 bytes
    each, in steps of 8 to 16), cut where its chunks change between ``kept`` (the first occurrence) and
    repeated; ``first_doc_id`` is where the first of its chunks occurs first. ``inside`` passages have all
    their chunks in this row only, several times. Every row is a text of its own, also without an id or with
    another row's: ``row`` tells rows apart, by the number in ``row_col`` or else by that of :func:`numbered`,
    where the first of equal ids is the first by its text's hash and null ids come after all others. Null or
    empty texts have no passages, nor has an empty table. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows, apart = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else [])), True
    if row_col is None:
        rows, apart = numbered(rows)
    shared = shared_chunks(rows).read()
    n = shared.count()
    found = occurrences(rows, shared, n).join(shared, ["hi", "lo"])
    in_row = Window.partitionBy("row").orderBy("start")
    found = found.withColumn("kept", (F.col("first_row") == F.col("row")) & (F.col("first_start") == F.col("start")))
    adjacent = F.coalesce(F.lag(F.col("start") + F.col("n_chars")).over(in_row) == F.col("start"), F.lit(False))
    found = found.withColumn("opens", (~adjacent).cast("int")).withColumn("turns", (~adjacent | (F.lag("kept").over(in_row) != F.col("kept"))).cast("int"))
    so_far = in_row.rowsBetween(Window.unboundedPreceding, 0)
    found = written(found.withColumn("run", F.sum("opens").over(so_far)).withColumn("piece", F.sum("turns").over(so_far)).drop("opens", "turns"), "shared-occurrences").read()
    runs = found.groupBy("row", "run").agg(F.sum("n_chars").alias("total"), F.min("start").alias("run_start"), F.max("start").alias("run_last"))
    possible = F.col("total").between(passage_chars - 2 * BESIDE[-1], passage_chars - 1)
    more = _extended(found, runs.where(possible))
    zero = F.lit(0)
    long = runs.join(more, ["row", "run"], "left").withColumns({c: F.coalesce(c, zero) for c in ("to_left", "to_right")})
    long = long.where(F.col("total") + F.col("to_left") + F.col("to_right") >= passage_chars)
    long = _apart(long)
    pieces = found.groupBy("row", "run", "piece").agg(
        F.min("start").alias("start"), F.max("start").alias("piece_last"), F.sum("n_chars").alias("n_chars"), F.first("kept").alias("kept"),
        F.min_by("first_row", "start").alias("first_row"), F.min("inside").alias("inside"),
    )
    before = F.when(F.col("start") == F.col("run_start"), F.col("to_left")).otherwise(zero)
    after = F.when(F.col("piece_last") == F.col("run_last"), F.col("to_right")).otherwise(zero)
    out = pieces.join(long, ["row", "run"])
    out = out.withColumns({"n_chars": F.col("n_chars") + before + after, "start": F.col("start") - before})
    if apart:
        ids = rows.select(F.col("row").alias("r"), "doc_id")
        first = ids.toDF("f", "first_doc_id")
        out = out.join(ids, out["row"] == ids["r"]).join(first, out["first_row"] == first["f"])
    else:
        out = out.withColumn("doc_id", F.col("row")).withColumn("first_doc_id", F.col("first_row"))
    return out.select("doc_id", "start", "n_chars", "kept", "first_doc_id", "inside", "row")


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``docs`` with the passages that are not ``kept`` cut out of their texts; all rows and columns stay.

    Passages find their row by ``row_col`` (see :func:`numbered`), or by its id where no id is null or repeated;
    otherwise it is an error, for they would be cut out of the wrong rows.
    """
    if row_col is None and passages.where("NOT row <=> doc_id").limit(1).count():
        raise ValueError("ids are null or repeat: number the rows first")
    row, out_col = unused(docs, "__row"), unused(docs, "__out")
    places = F.array_sort(F.collect_list(F.struct("start", "n_chars")))
    out = passages.where("NOT kept").groupBy(F.col("row").alias(row)).agg(places.alias(out_col))
    rows = docs.join(out, docs[row_col or id_col].cast("long") == out[row], "left")
    begins = f"concat(transform(`{out_col}`, x -> x.start), array(CAST(length(`{text_col}`) AS BIGINT)))"
    ends = f"concat(array(0L), transform(`{out_col}`, x -> x.start + x.n_chars))"
    rest = F.expr(f"array_join(zip_with({ends}, {begins}, (a, b) -> substring(`{text_col}`, CAST(a + 1 AS INT), CAST(b - a AS INT))), '')")
    return rows.select(*[F.when(F.col(out_col).isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
