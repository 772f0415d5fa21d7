"""Written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes (as JSON text) of a lookup that is broadcast; larger ones join by shuffle.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where it is unset and all tasks run in this process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_open = threading.local()


class Scratch:
    """Tables that are written inside go at the end, or with ``drop`` if ``keep`` is set.

    >>> with Scratch(): ...

    Scopes nest, and each thread has its own. Without any, tables go when the driver ends.
    """

    def __init__(self, keep: bool = False):
        self.keep, self.paths = keep, []

    def __enter__(self) -> Scratch:
        _open.scopes = [*getattr(_open, "scopes", []), self]
        return self

    def __exit__(self, *error) -> None:
        _open.scopes = _open.scopes[:-1]
        if not self.keep or error[0] is not None:
            self.drop()

    def drop(self) -> None:
        for where, fs in self.paths:
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)
        self.paths = []


def filesystem(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` after a trip through Parquet in the shared folder: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    where, fs = filesystem(spark, path)
    fs.deleteOnExit(where)
    if scopes := getattr(_open, "scopes", []):
        scopes[-1].paths.append((where, fs))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``df``, a written table, for broadcast if the texts of its rows have at most ``max_bytes``."""
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()["b"] or 0
    return F.broadcast(df) if held <= max_bytes else df


def per_distinct(rows: DataFrame, key: str, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``enrich`` adds to each distinct value of ``key`` (null included).

    Costly expressions thus run once per value. The values come back by broadcast if they are small, else by a
    shuffle join, whose skewed keys Spark splits.
    """
    found = written(enrich(rows.select(key).distinct()), f"distinct-{key}")
    found = small(found).withColumnRenamed(key, "__key")
    return rows.join(found, rows[key].eqNullSafe(found["__key"]), "left").drop("__key")
