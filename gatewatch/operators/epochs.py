"""Epochs: half-open windows from a start, every step, the last one cut at the end of the range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The defaults of window and step, and how long a marker holds (milliseconds).
WINDOW_MS = STEP_MS = 6 * 3_600_000
MARKER_MS = 8 * 3_600_000


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def scan_range(requests: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> tuple[int, int]:
    """The given bounds, else those of the requests (the last one included)."""
    if from_ms is None or to_ms is None:
        found = requests.agg(F.min(millis(F.col("created_at"))).alias("a"), F.max(millis(F.col("created_at"))).alias("b")).first()
        if found.a is None and (from_ms is None or to_ms is None):
            raise ValueError("there are no requests to take the range from")
        from_ms, to_ms = found.a if from_ms is None else from_ms, found.b + 1 if to_ms is None else to_ms
    if from_ms > to_ms:
        raise ValueError("the range ends before it starts")
    return from_ms, to_ms


def _positive(window_ms: int, step_ms: int) -> None:
    if window_ms <= 0 or step_ms <= 0:
        raise ValueError("window and step must be positive")


def epochs(spark: SparkSession, from_ms: int, to_ms: int, window_ms: int = WINDOW_MS, step_ms: int = STEP_MS) -> DataFrame:
    """``epoch, start_ms, end_ms`` of all windows."""
    _positive(window_ms, step_ms)
    count = max(0, -(-(to_ms - from_ms) // step_ms))
    start = F.lit(from_ms) + F.col("id") * step_ms
    return spark.range(count).select(F.col("id").cast("int").alias("epoch"), start.alias("start_ms"), F.least(start + window_ms, F.lit(to_ms)).alias("end_ms"))


def in_epochs(requests: DataFrame, from_ms: int, to_ms: int, window_ms: int = WINDOW_MS, step_ms: int = STEP_MS) -> DataFrame:
    """``requests`` with ``epoch, end_ms``, once for every window that holds them; gaps drop rows.

    The windows of a row follow from its time, so there is no join.
    """
    _positive(window_ms, step_ms)
    t = millis(F.col("created_at"))
    last = F.floor((t - from_ms) / F.lit(step_ms))
    first = F.greatest(F.lit(0), F.floor((t - from_ms - window_ms) / F.lit(step_ms)) + 1)
    inside = requests.where((t >= from_ms) & (t < to_ms)).withColumn("epoch", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return inside.withColumns({"epoch": F.col("epoch").cast("int"), "end_ms": F.least(F.lit(from_ms) + F.col("epoch") * step_ms + window_ms, F.lit(to_ms))})
