"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (characters, and the shapes of words with repetitions marked) are scaled by the
classes' log-count ratios; a linear hinge-loss model on the scaled rows is fitted by dual coordinate
descent on a bounded sample. Every whole text is scored in its own task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, labels
from .samples import ROWS_PER_CLASS, fold, labelled_texts, platt

BITS = 18
CHAR_GRAMS = 4
SHAPE_GRAMS = 3
POOL_WORDS = 200_000
_CLASSES = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([a-zß-öø-ÿ]+)|([0-9]+)")


def _shape(word: str) -> str:
    return _CLASSES.sub(lambda m: "A" if m[1] else "a" if m[2] else "0", word)


class Grams:
    """Distinct n-grams of a text, hashed to ``2**BITS`` numbers in ascending order."""

    def __init__(self):
        self.flags = np.zeros(1 << BITS, dtype=bool)
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.shapes: list[int] = []

    def _known(self, word: str) -> int:
        k = self.words[word] = len(self.shapes)
        self.shapes.append(zlib.crc32(_shape(word).encode()) & 0x3FFFFFFF)
        return k

    def of(self, text: str) -> np.ndarray:
        units = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint32) + np.uint32(1)
        self._flag(units, CHAR_GRAMS, 1)
        if len(self.words) > POOL_WORDS:
            self._clear()
        known, add = self.words.get, self._known
        index = [k if (k := known(w)) is not None else add(w) for w in text.split()]
        if index:
            index = np.array(index)
            shape = np.array(self.shapes, dtype=np.uint32)[index] if len(index) * 20 > len(self.shapes) else np.array([self.shapes[k] for k in index], dtype=np.uint32)
            shape[1:][index[1:] == index[:-1]] = 0x3FFFFFF1  # the word before, again
            self._flag(shape, SHAPE_GRAMS, 101)
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found

    def _flag(self, units: np.ndarray, longest: int, salt: int) -> None:
        gram = units
        for n in range(1, min(longest, len(units)) + 1):
            if n > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + units[n - 1 :]
            mixed = (gram ^ np.uint32(salt * 7919 + n)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            self.flags[mixed * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)] = True


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = np.full(1 << BITS, alpha)
    q = np.full(1 << BITS, alpha)
    for x, good in zip(rows, y, strict=True):
        (p if good else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost * hinge. The bias is the weight of a constant feature."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    square = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            change = (new - alpha[i]) * sign[i]
            if change:
                alpha[i] = new
                w[x] += change * v
                b += change
                worst = max(worst, abs(change))
        if worst < 1e-3:
            break
    return w, b


class QualityModel:
    """``weights`` is the ratio times the learned weight, ``squares`` the squared ratio, of each n-gram."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.squares = weights.astype(np.float32), squares.astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def margin(self, grams: np.ndarray) -> float:
        return float(self.weights[grams].sum(dtype=np.float64) / np.sqrt(self.squares[grams].sum(dtype=np.float64) + 1e-9) + self.bias)

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.offset, -30, 30))))


def _fit_linear(rows: list[np.ndarray], y: np.ndarray) -> QualityModel:
    ratio = log_count_ratios(rows, y)
    values = [ratio[x] / np.sqrt((ratio[x] ** 2).sum() + 1e-9) for x in rows]
    share = np.where(y > 0, y.mean(), 1 - y.mean())
    w, b = dual_coordinate_descent(rows, values, y, 0.5 / np.maximum(share, 1e-9) * 4.0, 1 << BITS)
    return QualityModel(ratio * w, ratio**2, b, 4.0, 0.0)


def fit(texts: list[tuple[str, int]]) -> QualityModel:
    """Fits on texts with labels 0 and 1; with one class only, or none, every score is that class's share."""
    y = np.array([label for _, label in texts])
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    grams = Grams()
    rows = [grams.of(t) for t, _ in texts]
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) == 2 and len(set(y[held])) == 2:
        part = _fit_linear([x for x, h in zip(rows, held, strict=True) if not h], y[~held])
        slope, offset = platt([part.margin(rows[i]) for i in np.flatnonzero(held)], y[held])
    else:
        slope, offset = 4.0, 0.0
    out = _fit_linear(rows, y)
    out.slope, out.offset = slope, offset
    return out


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text (null: of an empty one) in ``score_col``.

    All rows and columns pass, repeated rows and null ids too; a column called ``score_col`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != score_col]
    schema = docs.select(*names).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            scores = [model.score(grams.of(t.as_py() or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(scores, pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(run, schema)


def fit_on(docs: DataFrame, label_rows: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Learns ``quality`` from rows outside the held-out fold (crc32 of the id, mod 5, is 0)."""
    return fit(labelled_texts(docs, label_rows, "quality", fold(F.col("doc_id"), 5) != 0, rows_per_class))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_on(docs, labels(spark, sf_dir))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
