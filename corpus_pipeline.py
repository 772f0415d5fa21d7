"""Corpus pipeline: documents in, token ids of a deduplicated weighted mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Every stage works on all that its predecessor kept; empty tables pass through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm import exact_dedup, jaccard_join, mixing, pieces, quality
from gatewatch.llm.common import labels, unused, written

#: Share of good labels below which a document goes.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Rows are judged by their texts alone, null as empty."""
    model = quality.fit_on(docs, labels(spark, sf_dir))
    mark = unused(docs, "__quality")
    return quality.score(docs, model, score_col=mark).where(F.col(mark) >= LEAST_QUALITY).drop(mark)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest (then the smallest id, null last); null is empty."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more (on five-word shingles) connect, the one with the smallest id.

    Null ids come last and repeated ids are told apart by the rows' content; texts without words all stay.
    """
    return jaccard_join.deduplicated(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents to each source's target weight: one row for each time that a document is taken.

    A document that the budget's end falls into counts if at least half of it is within. Null and repeated ids
    are rows like all others; texts without words come once in each whole epoch of their source.
    """
    return mixing.mixed(docs, mixing.word_count(F.col("text")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with whether they decode to it. A null text is an empty one, without ids."""
    back = pieces.encode(docs.select("doc_id", "source", "text"), pieces.default_model(), decoded_col="decoded")
    return back.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("sentencepiece", tokenize),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}").read()
    return docs
