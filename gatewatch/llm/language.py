"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in each slot: the AND of an n-gram's slots gives all
languages that contain it in one go. A text's votes are the popcounts per language over its n-grams,
corrected for the false positives that the language's fill predicts; the largest corrected vote decides.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, documents, small, written
from .samples import fold

#: Rows of each language that its n-grams are learned from, about, chosen by a hash of their ids.
SAMPLE_ROWS = 6_000
#: A language with fewer learned rows keeps the n-grams of a single row too.
FEW_ROWS = 20
#: Distinct n-grams that a task counts before it hands them on.
HELD_GRAMS = 100_000
#: n-grams kept for each language at most, the most frequent first, and the share of its texts that an n-gram must be in.
GRAMS_PER_LANGUAGE = 6_000
LEAST_SHARE = 0.01
GRAM_SIZES = (2, 3, 4)
SLOT_BITS = 17
HASHES = 3
UNDETERMINED = "und"
#: Most distinct languages whose numbers are broadcast; beyond it the joins shuffle.
BROADCAST_LANGUAGES = 100_000
_PIECE = 1 << 19


def _letters(text: str) -> np.ndarray:
    """Code points of a text in lower case, with anything but letters as 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    top = int(points.max()) if len(points) else 0
    if top < 0x250:
        letter = _LATIN[points]
    else:
        distinct, where = np.unique(points, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in distinct.tolist()])[where]
    return np.where(letter, points, np.uint32(0))


def _blocks(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The letters of a text, runs of other characters as one 0, between two 0s; long texts in several blocks.

    A block begins with the end of the one before. Its second part says how much of it that is: n-grams that
    end there were counted before.
    """
    text = text.lower()
    tail = np.zeros(1, dtype=np.uint32)
    for start in range(0, len(text), _PIECE):
        points = _letters(text[start : start + _PIECE])
        if start + _PIECE >= len(text):
            points = np.concatenate([points, np.zeros(1, dtype=np.uint32)])
        points = np.concatenate([tail, points])
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
        points = points[keep]
        yield points, len(tail)
        tail = points[1 - max(GRAM_SIZES) :]


_LATIN = np.array([chr(c).isalpha() for c in range(0x250)])


def _grams(points: np.ndarray, old: int = 0) -> Iterator[np.ndarray]:
    """64-bit codes of the n-grams that end after the first ``old`` points, one array for each size.

    A blank stands only at an n-gram's ends.
    """
    for n in GRAM_SIZES:
        wide = points[max(0, old - n + 1) :].astype(np.uint64)
        if len(wide) < n:
            continue
        code = np.full(len(wide) - n + 1, n, dtype=np.uint64)
        inner = np.ones(len(code), dtype=bool)
        for k in range(n):
            part = wide[k : k + len(code)]
            code = code * np.uint64(0x100000001B3) + part
            if 0 < k < n - 1:
                inner &= part != 0
        if n == 2:
            inner &= (wide[: len(code)] != 0) | (wide[1:] != 0)
        yield code[inner]


def _distinct_grams(text: str) -> np.ndarray:
    found = [np.unique(code) for points, old in _blocks(text) for code in _grams(points, old)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _slots(code: np.ndarray) -> Iterator[np.ndarray]:
    h = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    for k in range(HASHES):
        yield (h >> np.uint64(64 - SLOT_BITS - 20 * k)) & np.uint64((1 << SLOT_BITS) - 1)


class LanguageFilter:
    """Bloom filters of any number of languages, sliced by bit: 64 languages a word, one row of slots for each word."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.languages = sorted(grams)
        self.slots = np.zeros((-(-len(self.languages) // 64), 1 << SLOT_BITS), dtype=np.uint64)
        for k, language in enumerate(self.languages):
            for at in _slots(np.asarray(grams[language], dtype=np.uint64)):
                np.bitwise_or.at(self.slots[k // 64], at, np.uint64(1 << k % 64))
        fill = np.array([(self.slots[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(self.languages))])
        self.false_rate = fill**HASHES
        self.everyone = np.array([(1 << min(64, len(self.languages) - 64 * w)) - 1 for w in range(len(self.slots))], dtype=np.uint64)

    def containing(self, code: np.ndarray, word: int = 0) -> np.ndarray:
        """Bitmask of the word's languages that (seem to) contain each n-gram."""
        out = None
        for at in _slots(code):
            out = self.slots[word][at] if out is None else out & self.slots[word][at]
        return out

    def votes(self, text: str) -> np.ndarray | None:
        """Corrected votes per language; None for a text without letters. Long texts are read whole, in blocks."""
        hits, n, any_letter = np.zeros(len(self.languages)), 0, False
        for points, old in _blocks(text):
            any_letter |= bool(points.any())
            for code in _grams(points, old) if self.languages else ():
                masks = [self.containing(code, word) for word in range(len(self.slots))]
                if len(self.languages) > 1:  # what all contain tells nothing
                    tells = masks[0] != self.everyone[0]
                    for mask, everyone in zip(masks[1:], self.everyone[1:], strict=True):
                        tells |= mask != everyone
                    masks = [mask[tells] for mask in masks]
                n += len(masks[0])
                for k in range(len(self.languages)):
                    hits[k] += np.count_nonzero(masks[k // 64] & np.uint64(1 << k % 64))
        if not any_letter:
            return None
        return np.maximum(hits - n * self.false_rate, 0) / (1 - self.false_rate)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the winner's lead over the second, as a share of both."""
        votes = self.votes(text) if text else None
        if votes is None or not len(votes):
            return UNDETERMINED, 0.0
        best = int(votes.argmax())
        second = float(np.delete(votes, best).max()) if len(votes) > 1 else 0.0
        total = float(votes[best]) + second
        return self.languages[best], float(votes[best] / total) if total > 0 else 0.0


def learn(docs: DataFrame, usable, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, least_share: float = LEAST_SHARE, few_rows: int = FEW_ROWS, most_grams: int | None = GRAMS_PER_LANGUAGE) -> LanguageFilter:
    """Learns the n-grams of each language from a bounded sample of its rows where ``usable`` holds.

    A language with up to ``sample_rows`` rows is learned from all of them, a larger one from those whose hash
    lies in the share that holds ``sample_rows`` on average. Each task counts the n-grams of its sampled texts;
    counts are summed per language and n-gram. Null texts and languages teach nothing, repeated rows count as
    often as they come, rows without an id share a hash and are drawn together, an empty table gives no languages.

    Kept are n-grams in ``least_share`` of a language's learned rows and at least two of them (from ``few_rows`` on),
    the ``most_grams`` most frequent. With a share of 0, ``few_rows`` None and ``most_grams`` None all n-grams are
    kept; the filter's size does not depend on it, but its false positives do.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("size")).coalesce(1), "language-sizes").read()
    languages = sizes.count()
    aimed = small(sizes.withColumnRenamed("lang", "of"), languages, BROADCAST_LANGUAGES)
    at = F.shiftrightunsigned(F.xxhash64(F.lit("language"), F.col("id")), 11) / F.lit(float(1 << 53))
    sample = rows.join(aimed, F.col("lang") == F.col("of")).where(at * F.col("size") < sample_rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = defaultdict(Counter), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counted in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted)), pa.array(list(counted), pa.int64()), pa.array(list(counted.values()), pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held -= len(found[lang])
                found[lang].update(_distinct_grams(text).view(np.int64).tolist())
                held += len(found[lang])
                if held > HELD_GRAMS:
                    yield from flush()
                    found, held = defaultdict(Counter), 0
        yield from flush()

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    learned = F.least("size", F.lit(sample_rows))
    least = learned * least_share if few_rows is None else F.when(learned < few_rows, 1.0).otherwise(F.greatest(F.lit(2.0), learned * least_share))
    frequent = counts.join(aimed, F.col("lang") == F.col("of")).where(F.col("n") >= least)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    if most_grams is not None:
        frequent = frequent.withColumn("nth", nth).where(F.col("nth") <= most_grams)
    top = frequent.groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    grams = {r.lang: np.zeros(0, np.uint64) for r in sizes.select("lang").collect()}
    grams |= {r.lang: np.array(r.grams, dtype=np.int64).view(np.uint64) for r in top.collect()}
    return LanguageFilter(grams)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; texts that are null or have no letter give ``und`` and 0.

    Of equal votes the language that comes first by its name wins. All rows pass, repeated ones too; columns
    called ``lang_pred`` or ``score`` are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*names).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 3) == 1
    model = learn(docs, ~held_out)  # a null id is in no fold
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
