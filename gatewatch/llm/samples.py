"""Bounded samples of labelled rows, for fitting the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a model is fitted on at most.
ROWS_PER_CLASS = 2_500
#: Bytes of text of each class from which on no further row is drawn. Texts are drawn whole, whatever their
#: length: the one that passes the bound is the last, so the driver holds this and one text more of each class.
BYTES_PER_CLASS = 16 << 20


def fold(id_col: Column, folds: int) -> Column:
    """``crc32(id as text) mod folds``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def class_shares(labels: DataFrame, label: str, learn: Column) -> dict[int, float]:
    """Share of each class among all labelled rows that may be learned from."""
    rows = labels.where(F.col(label).isNotNull() & learn).groupBy(F.col(label).cast("int").alias("y")).count().collect()
    total = sum(r["count"] for r in rows) or 1
    return {r.y: r["count"] / total for r in rows}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> list[tuple[str, int]]:
    """Whole texts and labels of at most ``rows_per_class`` rows of each class, in the order of a hash of their ids.

    ``learn`` says which ids may be learned from. Ids are picked from the short label rows first, then rows by
    their sizes, so no text is shuffled. A class ends early when its texts have ``bytes_per_class``. Null
    labels, null ids and null texts are left out; an id with several labels counts once, with the greatest.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    drawn = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows_per_class) for y in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * rows_per_class rows at most
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"), "text").join(ids, "doc_id")
    held, taken = {0: 0, 1: 0}, []
    for r in rows.select("doc_id", "th", "size", "y").orderBy(order, "doc_id", "th").limit(2 * rows_per_class).collect():
        if held[r.y] < bytes_per_class:
            taken.append((r.doc_id, r.th))
            held[r.y] += r.size
    if not taken:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(taken)), "c_id long, c_th long"))
    texts = rows.join(chosen, (F.col("doc_id") == F.col("c_id")) & (F.col("th") == F.col("c_th")))
    texts = texts.orderBy(order, "doc_id", "th").limit(2 * rows_per_class)
    return [(r.text, r.y) for r in texts.select("text", "y").collect()]


def platt(margins, labels, weights=None) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits labels to margins, by damped Newton steps."""
    import numpy as np

    x, y = np.asarray(margins, dtype=float), np.asarray(labels, dtype=float)
    if len(x) == 0 or y.min() == y.max():
        return 4.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.ones(len(x)) if weights is None else np.asarray(weights, dtype=float)
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))

    def loss(a: float, b: float) -> float:
        s = a * x + b
        return float((w * (np.logaddexp(0, s) - t * s)).sum())

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g, h = w * (p - t), w * p * (1 - p) + 1e-9
        ga, gb, haa, hab, hbb = (g * x).sum(), g.sum(), (h * x * x).sum() + 1e-6, (h * x).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step, now = 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(step * da) + abs(step * db) < 1e-7:
            break
    return max(a, 1e-3), b


def best_cut(margins, labels, weights=None) -> float:
    """The margin that splits the labels with the least weighted error; in the middle of the best gap."""
    import numpy as np

    order = np.argsort(margins, kind="stable")
    x, y = np.asarray(margins, dtype=float)[order], np.asarray(labels)[order]
    w = np.ones(len(x)) if weights is None else np.asarray(weights, dtype=float)[order]
    # error of a cut before place k: positives below it and negatives from it on
    error = np.concatenate([[0], np.cumsum(w * (y == 1))]) + np.concatenate([np.cumsum((w * (y == 0))[::-1])[::-1], [0]])
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[best[len(best) // 2]])
