"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two takes one
bucket at a time into memory, shuffles it with a seeded Fisher-Yates pass and hands it on or writes it. The
position in the whole shuffled order (the bucket's offset plus the position inside) deals the records out:
counts of shards differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, row_key, shuffle_partitions, small, unused, written

#: Bytes of text that a bucket holds on average; a task keeps one bucket in memory.
BUCKET_BYTES = 16 << 20
#: A bucket this many times larger than aimed at is dealt out again, by its rows' contents.
CROWDED = 8
#: Most buckets whose offsets are broadcast; beyond it that join shuffles.
BROADCAST_BUCKETS = 100_000


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of range(n): from the end, each place swaps with a uniformly drawn place up to it."""
    order = np.arange(n)
    if n > 1:
        draws = (np.random.default_rng(seed).random(n - 1) * np.arange(n, 1, -1)).astype(np.int64)
        for i, j in zip(range(n - 1, 0, -1), draws.tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``position``: a gapless uniformly random place from 0 in the whole table.

    The bucket depends on the seed and the id (of rows without an id: on the text), so neither a hot source
    nor many copies of a text fill a bucket. The order depends on the seed and the rows alone, not on how the
    input is partitioned or what tasks were lost: rows are put in a fixed order before they are shuffled, and
    those that agree in all columns are interchangeable. Where one id, or one text of rows without an id, fills
    a bucket many times over, that bucket is dealt out by the rows' contents and, of equal rows, their number.
    Null or empty texts are ordinary rows, an empty table stays empty, and columns called ``position``,
    ``__bucket``, ``__part`` or ``__offset`` in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("position", "__bucket", "__part", "__offset")
    bucket, part, offset = "__bucket", "__part", "__offset"
    key, copy = unused(docs, "__key"), unused(docs, "__copy")
    size = text_bytes(F.col(text_col)) + 64
    sized = docs.agg(F.sum(size).alias("b")).first()["b"] or 0
    buckets = max(2 * shuffle_partitions(spark), math.ceil(sized / bucket_bytes))
    spread = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))).otherwise(F.xxhash64(F.lit(seed), F.lit("text"), F.col(text_col)))
    place = [bucket, part]
    rows = docs.withColumns({bucket: F.pmod(spread, F.lit(buckets)).cast("long"), part: F.lit(0).cast("long"), key: row_key(docs)})
    count = lambda: rows.groupBy(*place).agg(F.count("*").alias("n"), F.sum(size).alias("held"))
    counts = written(count(), "shuffle-counts").read()
    crowded = counts.where(F.col("held") > CROWDED * bucket_bytes).select(F.col(bucket).alias("b"), F.ceil(F.col("held") / bucket_bytes).alias("parts"))
    n_crowded = crowded.count()
    if n_crowded:
        marked = rows.join(small(crowded, n_crowded, BROADCAST_BUCKETS), F.col(bucket) == F.col("b"), "left")
        calm = marked.where("parts IS NULL").drop("b", "parts")
        # equal rows become one before they travel, and come back by their number
        single = _numbered_copies(marked.where("parts IS NOT NULL").drop("b"), copy)
        dealt = single.withColumn(part, F.pmod(F.xxhash64(key, copy), F.col("parts"))).select(calm.columns)
        rows = written(calm.unionByName(dealt), "shuffle-split").read()
        counts = written(count(), "shuffle-counts").read()
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset)), "shuffle-offsets").read()
    rows = rows.join(small(offsets, counts.count(), BROADCAST_BUCKETS), place)
    names = docs.columns

    def shuffled(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pd.DataFrame({"id": pdf[id_col], "text": pdf[text_col].fillna(""), "key": pdf[key]})
        pdf = pdf.loc[keys.sort_values(["id", "text", "key"], kind="stable").index].reset_index(drop=True)
        places = np.empty(len(pdf), dtype=np.int64)
        which = (seed, int(pdf[bucket].iat[0]), int(pdf[part].iat[0]))
        places[fisher_yates(len(pdf), hash(which) & 0x7FFFFFFF)] = np.arange(len(pdf))
        pdf["position"] = places + int(pdf[offset].iat[0])
        return pdf[[*names, "position"]]

    schema = docs.withColumn("position", F.lit(0).cast("long")).schema
    return rows.groupBy(*place).applyInPandas(shuffled, schema)


def _numbered_copies(rows: DataFrame, copy: str) -> DataFrame:
    """``rows`` with the number of each among those that agree in all columns; maps agree in any order."""
    maps = [f.name for f in rows.schema.fields if f.dataType.typeName() == "map"]
    listed = rows.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}) if maps else rows
    counted = listed.groupBy(*[F.col(f"`{c}`") for c in listed.columns]).agg(F.count("*").alias(copy))
    single = counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
    return single.withColumns({c: F.map_from_entries(c) for c in maps}) if maps else single


def shard(docs: DataFrame, shards: int, seed: int = 0, **how) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard)."""
    placed = external_shuffle(docs.drop("shard", "slot"), seed, **how)
    return placed.select("*", F.pmod("position", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot")).drop("position")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, **how) -> None:
    """Writes ``path/shard=K/*.parquet``; within a shard, ``slot`` gives the shuffled order."""
    shard(docs, shards, seed, **how).write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), 24, seed=1)
    return out.select(
        "doc_id",
        (text_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
