"""Requests summed up in panes, from which any epochs can be put together.

A pane is as long as the greatest common divisor of window and step, so that every epoch is a run of whole
panes. In a pane, requests that agree in all that metrics look at become one row with their number, their first
(time, id) and their time range. Panes of several batches merge, and no window counts a request anew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .epochs import millis

#: What metrics and strategies tell requests apart by.
KEYS = ("ip", "route", "user_agent", "asn", "is_tor", "threat_rank", "is_attack")


def pane_ms(window_ms: int, step_ms: int) -> int:
    if window_ms <= 0 or step_ms <= 0:
        raise ValueError("window and step must be positive")
    return math.gcd(window_ms, step_ms)


def _summed(rows: DataFrame, n, first, first_at, last_at) -> DataFrame:
    found = rows.groupBy("pane", *KEYS).agg(n.alias("n"), F.min(first).alias("first"), F.min(first_at).alias("first_at"), F.max(last_at).alias("last_at"))
    return found.select("pane", *KEYS, "n", F.col("first.ms").alias("first_ms"), F.col("first.id").alias("first_id"), "first_at", "last_at")


def in_panes(requests: DataFrame, from_ms: int, to_ms: int | None, pane: int) -> DataFrame:
    """``pane, n, first_ms, first_id, first_at, last_at`` and the keys, of classified requests with ``id, created_at``.

    Requests before ``from_ms`` or not before ``to_ms`` are left out. Equal requests are summed in the reading
    tasks, so one address that sends a third of all requests is a few rows.
    """
    t = millis(F.col("created_at"))
    inside = requests.where((t >= from_ms) & (t < to_ms) if to_ms is not None else t >= from_ms).withColumn("pane", F.floor((t - from_ms) / F.lit(pane)))
    return _summed(inside, F.count("*"), F.struct(t.alias("ms"), "id"), F.col("created_at"), F.col("created_at"))


def merged(panes: DataFrame) -> DataFrame:
    """Panes of several batches as if they had been one."""
    return _summed(panes, F.sum("n"), F.struct(F.col("first_ms").alias("ms"), F.col("first_id").alias("id")), F.col("first_at"), F.col("last_at"))


def in_epochs(panes: DataFrame, from_ms: int, to_ms: int, window_ms: int, step_ms: int) -> DataFrame:
    """``panes`` with ``epoch, end_ms`` instead of their number, once for every window that holds them; gaps drop rows."""
    size = pane_ms(window_ms, step_ms)
    last = F.floor(F.col("pane") / F.lit(step_ms // size))
    first = F.greatest(F.lit(0), F.floor((F.col("pane") - window_ms // size) / F.lit(step_ms // size)) + 1)
    rows = panes.withColumn("epoch", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).drop("pane")
    return rows.withColumn("epoch", F.col("epoch").cast("int")).withColumn("end_ms", F.least(F.lit(from_ms) + F.col("epoch") * F.lit(step_ms).cast("long") + window_ms, F.lit(to_ms)))
