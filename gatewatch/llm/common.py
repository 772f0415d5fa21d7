"""What the training-data operators share: inputs, scratch tables and checked broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: A word of every contract here.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose parts one bucket takes at most on average; a task keeps its bucket in memory.
BUCKET_BYTES = 64 << 20


def text_buckets(docs: DataFrame, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for what is made of all texts: the session's shuffle partitions, or more where these would hold too much."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), math.ceil(size / bucket_bytes))


#: Rows of text in one Arrow batch; Spark's default of 10,000 long texts would take hundreds of MB on either side.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to ``BATCH_ROWS``, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where it is unset and all tasks run in this process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Table:
    """A written intermediate result: it cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        where, fs = _filesystem(self.spark, self.path)
        fs.delete(where, True)


def written(df: DataFrame, name: str) -> Table:
    """Writes ``df`` as Parquet in the shared folder. Left-over tables go when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _filesystem(spark, path)
    fs.deleteOnExit(where)
    return Table(spark, path, df.schema)


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Marks ``df`` for broadcast if its counted ``rows`` are within ``max_rows``; else it is joined by shuffle."""
    return F.broadcast(df) if rows <= max_rows else df


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame) -> Column:
    """128 bits of a row's content, as text: rows that agree in all columns (but for maps) share it, others don't."""
    names = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    seen = [x for n in names for x in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]  # a hash skips nulls
    return F.concat_ws(":", F.xxhash64(F.lit(1), *seen), F.xxhash64(F.lit(2), *seen))


#: Most rows of fixed width that are broadcast to pick rows out of a table; beyond it that join shuffles.
BROADCAST_KEYS = 100_000


def picked(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """One of ``rows`` for each ``key`` in ``kept`` (``key, copies``, keys distinct), with the other columns of ``kept``.

    Where a key has several copies, its rows agree in all columns; they collapse in the reading tasks.
    """
    out = rows.join(kept.where("copies = 1").drop("copies"), key)
    several = kept.where("copies > 1").drop("copies")
    n = several.count()
    if n:
        found = rows.join(small(several, n, BROADCAST_KEYS), key)
        out = out.unionByName(found.dropDuplicates([key]))
    return out


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    found = [left[n].eqNullSafe(right[n]) for n in names]
    out = found[0]
    for x in found[1:]:
        out = out & x
    return out
