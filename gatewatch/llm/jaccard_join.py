"""N-gram Jaccard self-join by vertical partitioning.

1. A document is its set of word shingles; documents with equal sets are one class from then on.
2. Shingles meet in buckets of their hash, packed as arrays, and learn in how many classes they are. Only
   shared ones go on to their class. The global order is (number of classes, hash): rare first. A shingle
   that many classes of one flush of a task have goes there as a number only; the flush's entries wait in its
   home bucket for the answer. So a shingle of all classes fills no bucket.
3. Two sets that are similar enough share a shingle in their prefixes. A class whose prefix is all its own is
   out; the rest is counted once more among itself.
4. A pair's overlap is counted by vertical partitions: the global order is cut into fragments, partial
   overlaps are counted per fragment and summed per pair.
5. Pairs come in two rounds. First every member of a prefix shingle's list is paired with the list's most
   central member, which joins large groups of near copies without listing their pairs. Then every pair of
   a list whose members are still in different components is tried. Together they miss no link between
   components, so the components are exact; pairs inside a component are not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Table, bounded_batches, documents, picked, row_key, text_buckets, unused, written
from .components import components
from .shingles import SLICE_BYTES, shingle_sets

#: Vertical partitions of the global order.
FRAGMENTS = 8
#: Shingles that a task packs at once.
PACK = 2_000_000
#: Classes of one flush (about ``PACK`` shingles) from which on a shingle is sent to its bucket as a number.
OFTEN = 16
#: Rounds of counting in how many of the remaining classes a shingle is.
COUNTS = 2
#: Bits of a flush's number within its task, and how far apart the homes of a task's flushes are (a prime).
_TASK_SHIFT, _STRIDE = 24, 2_654_435_761
#: What a packed row holds, in its column ``n``; ``class`` is the number of the flush, if it matters.
_SETS, _ASKED, _HELD, _TOLD = range(4)

_PACKED = "bucket int, doc_id bigint, row string, n bigint, class bigint, payload binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row", pa.string()), ("n", pa.int64()), ("class", pa.int64()), ("payload", pa.binary())])


def _batch(bucket, doc_id, row, n, cls, payload) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((bucket, doc_id, row, n, cls, payload), _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)


def _payload_batch(buckets: list[int], payloads: list[bytes], kind: int = _SETS, flush: int = 0) -> pa.RecordBatch:
    k = len(buckets)
    return _batch(buckets, [None] * k, [None] * k, [kind] * k, [flush] * k, payloads)


def _pack(bucket: np.ndarray, cls: np.ndarray, n: np.ndarray, owner: np.ndarray, *columns: np.ndarray, kind: int = _SETS, flush: int = 0) -> Iterator[pa.RecordBatch]:
    """One row per bucket: the classes with their set sizes and counts here, then the columns.

    ``owner`` numbers the class of each entry, ascending.
    """
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, owner, columns = bucket[order], owner[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    names, rows = [], []
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        who = owner[a:b][first]
        counts = np.diff(np.append(first, b - a))
        names.append(int(bucket[a]))
        rows.append(b"".join([np.array([len(who), b - a], dtype=np.int64).tobytes(), cls[who].tobytes(), n[who].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), *(c[a:b].tobytes() for c in columns)]))
        if len(rows) == 64:
            yield _payload_batch(names, rows, kind, flush)
            names, rows = [], []
    if rows:
        yield _payload_batch(names, rows, kind, flush)


def _unpack(payloads: list[bytes], dtypes: list[type]) -> tuple[np.ndarray, ...]:
    """Classes, set sizes, the owner of each entry, and the columns, of all payloads."""
    parts: list[list[np.ndarray]] = [[] for _ in range(3 + len(dtypes))]
    seen = 0
    for raw in payloads:
        k, m = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16
        for i, (dtype, count) in enumerate([(np.int64, k), (np.int32, k), (np.int32, k), *((d, m) for d in dtypes)]):
            values = np.frombuffer(raw, dtype, count, at)
            at += values.nbytes
            if i == 2:
                values = np.repeat(np.arange(seen, seen + k), values)
            parts[i].append(values)
        seen += k
    empty = [np.int64, np.int32, np.int64, *dtypes]
    cls, n, owner, *columns = (np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, empty, strict=True))
    # a class that several tasks have seen is one
    keys = np.stack([cls, n.astype(np.int64)], axis=1) if len(cls) else np.zeros((0, 2), np.int64)
    distinct, number = np.unique(keys, axis=0, return_inverse=True)
    return distinct[:, 0].copy(), distinct[:, 1].copy(), number.reshape(-1)[owner], *columns


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """Kind, flush and payload of packed rows."""
    for batch in batches:
        yield from zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)


def _flushed(number: int, cls: np.ndarray, n: np.ndarray, owner: np.ndarray, hashes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The shingles of some classes, packed by their buckets; of those that many have, questions instead."""
    cell = hashes >> np.uint64(44)
    busy = np.flatnonzero(np.bincount(cell.astype(np.int64), minlength=1 << 20)[cell.astype(np.int64)] >= OFTEN)
    often = np.zeros(len(hashes), dtype=bool)
    if len(busy):
        values, where, counts = np.unique(hashes[busy], return_inverse=True, return_counts=True)
        often[busy[counts[where] >= OFTEN]] = True
        values, counts = values[counts >= OFTEN], counts[counts >= OFTEN]
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    yield from _pack(bucket[~often], cls, n, owner[~often], hashes[~often])
    if often.any():
        home = np.full(int(often.sum()), _home(number, buckets), dtype=np.int32)
        yield from _pack(home, cls, n, owner[often], hashes[often], kind=_HELD, flush=number)
        yield from _lists((values % np.uint64(buckets)).astype(np.int64), values, counts, _ASKED, number)


def _lists(bucket: np.ndarray, values: np.ndarray, counts: np.ndarray, kind: int, flush: int) -> Iterator[pa.RecordBatch]:
    """Hashes with numbers, one row a bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    names, rows = [], []
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        part = order[a:b]
        names.append(int(bucket[part[0]]))
        rows.append(values[part].astype(np.uint64).tobytes() + counts[part].astype(np.int64).tobytes())
    yield _payload_batch(names, rows, kind, flush)


def _listed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(raw) // 16
    return np.frombuffer(raw, np.uint64, k), np.frombuffer(raw, np.int64, k, 8 * k)


def _number(k: int) -> int:
    """Of a task's k-th flush; a repeated task gives the same."""
    return TaskContext.get().partitionId() << _TASK_SHIFT | k


def _home(number: int, buckets: int) -> int:
    """The bucket where a flush waits: tasks follow each other round the buckets, and so do each task's flushes."""
    task, k = number >> _TASK_SHIFT, number & (1 << _TASK_SHIFT) - 1
    return (task + k * _STRIDE) % buckets


def _sets(words: int, buckets: int):
    """Rows of the documents (id, row key, set size, class), and their classes' shingles packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        waiting = flushes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                hashes = np.concatenate([h for _, _, h in held])
                owner = np.repeat(np.arange(len(held)), [len(h) for _, _, h in held])
                cls, n = np.array([c for c, _, _ in held]), np.array([k for _, k, _ in held])
                yield from _flushed(_number(flushes), cls, n, owner, hashes, buckets)

        for batch in batches:
            ids, rows, texts = (batch.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < SLICE_BYTES):
                    size += len(texts[stop] or "")
                    stop += 1
                flat, counts = shingle_sets(texts[at:stop], words)
                ends = np.cumsum(counts)
                found = []
                for k, n in enumerate(counts.tolist()):
                    mine = flat[ends[k] - n : ends[k]]
                    cls = int(np.uint64(xxhash.xxh3_64_intdigest(mine.tobytes())).view(np.int64)) if n else None
                    found.append(cls)
                    if n and (cls, n) not in seen:
                        seen.add((cls, n))
                        held.append((cls, n, mine))
                        waiting += n
                yield _batch([k % buckets for k in range(at, stop)], ids[at:stop], rows[at:stop], counts, found, [None] * (stop - at))
                if waiting >= PACK:
                    yield from flush()
                    held.clear()
                    waiting, flushes = 0, flushes + 1
                at = stop
        yield from flush()

    return run


def _count(buckets: int):
    """In a bucket of shingles: the number of classes of each; those in several go on, packed by class.

    Questions are answered to the flush's home bucket. A class that several flushes counted counts several
    times in a number; such a shingle is in many classes anyway, and its place in the order is the same to all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, asked = [], []
        for batch in batches:
            kinds = batch.column(3).to_numpy(zero_copy_only=False)
            rest = np.array(batch.column(5).is_null()) | (kinds == _HELD)
            if rest.any():
                yield batch.filter(pa.array(rest))
            for kind, flush, raw in _payloads(iter([batch.filter(pa.array(~rest))])):
                (asked.append((flush, *_listed(raw))) if kind == _ASKED else packed.append(raw))
        cls, n, owner, hashes = _unpack(packed, [np.uint64])
        del packed
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        keep = np.ones(len(hashes), dtype=bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[keep], owner[keep]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        values, where, counts = hashes[new], np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(hashes)))
        if asked:
            every = np.unique(np.concatenate([values, *(v for _, v, _ in asked)]))
            total = np.zeros(len(every), dtype=np.int64)
            total[np.searchsorted(every, values)] = counts
            for _, v, c in asked:
                total[np.searchsorted(every, v)] += c
            for flush, v, _ in asked:
                yield from _lists(np.full(len(v), _home(flush, buckets)), v, total[np.searchsorted(every, v)], _TOLD, flush)
            counts = total[np.searchsorted(every, values)]
        df = np.minimum(counts[where], _MOST).astype(np.int32) if len(hashes) else np.zeros(0, np.int32)
        many = df > 1
        hashes, owner, df = hashes[many], owner[many], df[many]
        order = np.argsort(owner, kind="stable")
        hashes, owner, df = hashes[order], owner[order], df[order]
        yield from _pack(_class_bucket(cls, buckets)[owner], cls, n, owner, hashes, df)

    return run


_MOST = 2**31 - 1


def _class_bucket(cls: np.ndarray, buckets: int) -> np.ndarray:
    return (cls.view(np.uint64) % np.uint64(buckets)).astype(np.int32)


def _answered(buckets: int):
    """In a home bucket: what flushes held, with the numbers that they were told, packed by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = {}, {}
        for kind, flush, raw in _payloads(batches):
            (held if kind == _HELD else told).setdefault(flush, []).append(raw)
        for flush, raws in held.items():
            cls, n, owner, hashes = _unpack(raws, [np.uint64])
            parts = [_listed(raw) for raw in told[flush]]
            values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(values)
            df = np.minimum(counts[order][np.searchsorted(values[order], hashes)], _MOST).astype(np.int32)
            order = np.argsort(owner, kind="stable")
            hashes, owner, df = hashes[order], owner[order], df[order]
            yield from _pack(_class_bucket(cls, buckets)[owner], cls, n, owner, hashes, df)

    return run


def prefix(n, percent: int):
    """Length of the prefix in which a set of size n shares a shingle with every set similar enough."""
    return n - (n * percent + 99) // 100 + 1


_SURVIVORS = "class bigint, n bigint, shingles array<bigint>, dfs array<int>"


def _survivors(percent: int):
    """In a bucket of classes: those whose prefix holds a shared shingle, with their shared shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, n, owner, hashes, df = _unpack([raw for _, _, raw in _payloads(batches)], [np.uint64, np.int32])
        hashes = hashes.view(np.int64)
        order = np.lexsort((hashes, df, owner))
        hashes, df, owner = hashes[order], df[order], owner[order]
        keep = np.ones(len(hashes), dtype=bool)  # several flushes may have held a class
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        shared = np.bincount(owner[keep], minlength=len(cls))
        stays = n - shared < prefix(n, percent)
        keep &= stays[owner]
        hashes, df = hashes[keep], df[keep]
        ends = np.concatenate([[0], np.cumsum(shared[stays])])
        for a in range(0, int(stays.sum()), 500):
            b = min(a + 500, int(stays.sum()))
            bounds = pa.array(ends[a : b + 1] - ends[a], pa.int32())
            part = slice(ends[a], ends[b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[stays][a:b]), pa.array(n[stays][a:b]), pa.ListArray.from_arrays(bounds, pa.array(hashes[part])), pa.ListArray.from_arrays(bounds, pa.array(df[part], pa.int32()))],
                names=["class", "n", "shingles", "dfs"],
            )

    return run


def _repacked(buckets: int):
    """The shared shingles of the classes that are left, packed by bucket again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, flushes = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                cls, n, counts, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from _flushed(_number(flushes), cls, n, np.repeat(np.arange(len(cls)), counts), hashes, buckets)

        for batch in batches:
            lists = batch.column(2)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy().view(np.uint64)))
            waiting += len(held[-1][3])
            if waiting >= PACK:
                yield from flush()
                held, waiting, flushes = [], 0, flushes + 1
        yield from flush()

    return run


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket"))


def shared_sets(docs: DataFrame, words: int, percent: int) -> tuple[Table, Table]:
    """Of ``doc_id, row, text``: the table ``doc_id, row, n, class``, and the classes that may have links."""
    bounded_batches(docs.sparkSession)
    buckets = text_buckets(docs, "text")
    rows = docs.select("doc_id", "row", "text").mapInArrow(_sets(words, buckets), _PACKED)
    counted = written(_dealt(rows, buckets).mapInArrow(_count(buckets), _PACKED), "shingle-counts")
    members = written(counted.read().where("payload IS NULL").select("doc_id", "row", "n", "class"), "shingle-members")
    left = _remaining(counted, buckets, percent)
    for _ in range(COUNTS - 1):
        counted = written(_dealt(left.read().mapInArrow(_repacked(buckets), _PACKED), buckets).mapInArrow(_count(buckets), _PACKED), "shingle-counts")
        left.drop()
        left = _remaining(counted, buckets, percent)
    return members, left


def _remaining(counted: Table, buckets: int, percent: int) -> Table:
    packed = counted.read().where("payload IS NOT NULL")
    told = _dealt(packed.where(F.col("n").isin(_HELD, _TOLD)), buckets).mapInArrow(_answered(buckets), _PACKED)
    sets = packed.where(F.col("n") == _SETS).unionAll(told)
    left = written(_dealt(sets, buckets).mapInArrow(_survivors(percent), _SURVIVORS), "shingle-sets")
    counted.drop()
    return left


def _order_key(shingle: Column, df: Column) -> Column:
    return df.cast("double") + shingle.cast("double") / float(2**64) + 0.5


def pivots(sets: DataFrame) -> list[float]:
    """Cuts of the global order into fragments of about equal use. Any cuts give the same overlaps."""
    used = sets.select(F.explode(F.arrays_zip("shingles", "dfs")).alias("x")).where(F.pmod("x.shingles", F.lit(16)) == 0)
    found = used.agg(F.percentile_approx(_order_key(F.col("x.shingles"), F.col("x.dfs")), [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000).alias("p")).first()["p"]
    return sorted(set(found or []))


def segments(sets: DataFrame, cuts: list[float]) -> DataFrame:
    """``class, fragment, part``: the shingles of each class in each fragment of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for cls, shingles, dfs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                values = shingles.values.to_numpy()
                key = dfs.values.to_numpy().astype(float) + values.astype(float) / float(2**64) + 0.5
                at = [0, *np.searchsorted(key, cuts).tolist(), len(values)]
                for f, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    if b > a:
                        out[0].append(cls)
                        out[1].append(f)
                        out[2].append(values[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))], names=["class", "fragment", "part"])

    return sets.select("class", "shingles", "dfs").mapInArrow(run, "class bigint, fragment int, part array<bigint>")


def links(pairs: DataFrame, sets: DataFrame, cuts: list[float], percent: int) -> DataFrame:
    """The pairs (``x, nx, y, ny``) that are similar enough, with ``overlap``."""
    needed = pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct()
    parts = written(segments(sets.join(needed, sets["class"] == needed["c"], "left_semi"), cuts), "shingle-segments").read()
    mine = pairs.join(parts.toDF("c", "fragment", "mine"), F.col("x") == F.col("c")).drop("c")
    other = parts.toDF("c", "f", "theirs")
    both = mine.join(other, (F.col("y") == F.col("c")) & (F.col("fragment") == F.col("f")))
    partial = both.select("x", "nx", "y", "ny", F.size(F.array_intersect("mine", "theirs")).cast("long").alias("partial"))
    summed = partial.groupBy("x", "nx", "y", "ny").agg(F.sum("partial").alias("overlap"))
    return summed.where(F.col("overlap") * 100 >= (F.col("nx") + F.col("ny") - F.col("overlap")) * percent)


def _possible(percent: int, nx: str, px: str, ny: str, py: str) -> Column:
    """If the shingle at these places is the pair's first common one, enough of both sets is left."""
    least = F.ceil((F.col(nx) + F.col(ny)) * percent / (100 + percent) - 1e-9)
    return (F.col(nx) - F.col(px) >= least) & (F.col(ny) - F.col(py) >= least)


def class_components(sets: DataFrame, percent: int) -> Table:
    """``node, component`` of the classes that have a link."""
    shared = F.size("shingles")
    own = F.col("n") - shared
    in_prefix = F.slice("shingles", 1, F.greatest(F.lit(0), F.least(shared, (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - own).cast("int"))))
    lists = sets.select("class", "n", own.alias("own"), F.posexplode(in_prefix).alias("k", "shingle"))
    lists = written(lists.select("shingle", "class", "n", "own", (F.col("own") + F.col("k")).alias("place")), "prefix-lists")
    rows = lists.read()
    cuts = pivots(sets)
    # most central: the smallest share of shingles of its own
    central = F.min(F.struct((F.col("own") / F.col("n")).alias("alone"), F.xxhash64("class").alias("h"), F.col("class").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py")))
    leaders = written(rows.groupBy("shingle").agg(central.alias("l"), F.count("*").alias("m")).where("m > 1").select(F.col("shingle").alias("s"), "l.y", "l.ny", "l.py"), "prefix-leaders").read()
    near = rows.join(leaders, rows["shingle"] == leaders["s"]).where((F.col("class") != F.col("y")) & _possible(percent, "n", "place", "ny", "py"))
    ordered = _ordered(near, "class", "n", "y", "ny")
    tried = written(ordered, "pairs-central").read()
    found = written(links(tried, sets, cuts, percent).select(F.col("x").alias("a"), F.col("y").alias("b")), "links-central").read()
    labels = components(found)
    # all pairs of a list whose members are in different components, of which one isn't its leader's
    of = labels.read().toDF("node", "component")
    placed = rows.join(of, rows["class"] == of["node"], "left").select("shingle", "class", "n", "place", F.coalesce("component", "class").alias("component"))
    led = leaders.join(of, leaders["y"] == of["node"], "left").select("s", F.coalesce("component", "y").alias("main"))
    led = written(led, "prefix-main").read()
    placed = written(placed, "prefix-placed").read()
    placed = written(placed.join(led, placed["shingle"] == led["s"]).select("shingle", "class", "n", "place", "component", (F.col("component") != F.col("main")).alias("outside")), "prefix-outside").read()
    # sets whose sizes are too far apart never meet: sizes form blocks, and only neighbouring blocks are joined
    block = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-6))).cast("int") if percent < 100 else F.col("n").cast("int")
    placed = placed.withColumn("block", block)
    outside = placed.where("outside").withColumn("near", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    outside = outside.select(F.col("shingle").alias("s"), F.col("class").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("component").alias("other"), "near")
    across = placed.join(outside, (placed["shingle"] == outside["s"]) & (placed["block"] == outside["near"])).where((F.col("component") != F.col("other")) & (~F.col("outside") | (F.col("class") < F.col("y"))) & _possible(percent, "n", "place", "ny", "py"))
    rest = _ordered(across, "class", "n", "y", "ny").join(tried, ["x", "nx", "y", "ny"], "left_anti")
    rest = written(rest, "pairs-across").read()
    more = written(links(rest, sets, cuts, percent).select(F.col("x").alias("a"), F.col("y").alias("b")), "links-across").read()
    lists.drop()
    if not more.limit(1).count():
        return labels
    return components(found.unionAll(more))


def _ordered(pairs: DataFrame, a: str, na: str, b: str, nb: str) -> DataFrame:
    first = F.col(a) < F.col(b)
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(pick(a, b).alias("x"), pick(na, nb).alias("nx"), pick(b, a).alias("y"), pick(nb, na).alias("ny")).distinct()


def linked(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id, row, n, component, component_id``, one row per input row.

    ``row`` is ``row_col`` (a text that tells rows apart) or null, ``component`` a number that the rows of one
    component share (null without shingles), whether they have ids or not.
    """
    row = F.col(row_col) if row_col else F.lit(None).cast("string")
    members, sets = shared_sets(docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).alias("text")), words, percent)
    labels = class_components(sets.read(), percent).read()
    rows = members.read()
    classes = rows.where("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, classes["class"] == labels["node"], "left").select("class", "n", "least", F.coalesce("component", "class").alias("component"))
    classes = written(classes, "class-components").read()
    least = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids").read()
    named = written(classes.join(least, "component").select(F.col("class").alias("c"), F.col("n").alias("m"), "component", "component_id"), "class-ids").read()
    out = rows.join(named, (rows["class"] == named["c"]) & (rows["n"] == named["m"]), "left")
    return out.select("doc_id", "row", "n", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row.

    Two documents link when 100 * intersection >= percent * union of their sets of ``words``-word shingles
    (A to Z in lower case; a text with fewer words is one shingle). ``component_id`` is the smallest id that
    links reach, the row's own included. A text without words, or null, has no shingles and no links. A null
    id has no say in the smallest; rows that repeat an id count by their texts. Shingles are told apart by a
    64-bit hash, classes by a 64-bit hash of the set together with its size: two different ones among k share
    it with a chance of about k * k / 2**65. Other columns are not read; empty tables stay empty.
    """
    return linked(docs, words, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: one of each component of :func:`jaccard_join`.

    The smallest id stays, null after all others, then the smallest hash of the whole row; so neither null nor
    repeated ids keep a near copy. Of rows that agree in everything one stays. Rows without a word all stay.
    """
    row = unused(docs, "__row")
    keyed = docs.withColumn(row, row_key(docs))
    found = linked(keyed, words, percent, id_col, text_col, row)
    found = written(found.groupBy("doc_id", "row", "n", "component").agg(F.count("*").alias("copies")), "near-rows").read()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "copies")
    best = found.where("n > 0").groupBy("component").agg(F.min(order).alias("b")).select(F.col("b.row").alias(row), "b.copies")
    out = picked(keyed, written(best, "near-kept").read(), row)
    wordless = keyed.where(~F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)))
    return out.unionByName(wordless).select(*docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir), words=4, percent=85)


OP6_SQL = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
shingles AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.c < b.c AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.c, b.c),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (n + m - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, least) AS (
  SELECT c, c FROM classes
  UNION
  SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.c WHERE r.least < e.b),
component AS (SELECT c, min(least) AS component_id FROM reach GROUP BY c)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes ON list_sort(d.s) = classes.s LEFT JOIN component ON component.c = classes.c
"""
