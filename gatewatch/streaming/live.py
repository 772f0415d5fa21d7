"""Live classification and detection with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalogs import Catalog, load
from ..functions.scalars import SENSITIVE_KEYS, forwarding_chain, is_ipv4, redacted, source_of, token_claims, token_of
from ..operators import panes
from ..operators.campaigns import MIN_CONFIDENCE, fold, upsert
from ..operators.classify import add_rate_limits, check_addresses, classify, leveled, method_signals, url_signals
from ..operators.enrich import Geography, enriched
from ..operators.epochs import MARKER_MS, WINDOW_MS, millis
from ..plans.detect import context_of_panes, detected
from ..sources.refresh import Refreshed
from ..sources.sinks import CampaignFolder
from ..tables import Scratch, filesystem, written

#: What a raw request has beyond the columns that are stored.
_TRANSIENT = ("x_forwarded_for", "cf_connecting_ip", "cf_ip_country", "rate_tier", "rate_severity", "rate_count", "rate_limit", "cookies", "headers", "response_headers", "started_ms", "finished_ms")


def requests_stream(spark: SparkSession, path: str, schema, skip_paths: tuple[str, ...] = ()) -> DataFrame:
    """Raw requests as JSON files arrive; paths to skip are dropped at once."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.where(~F.col("route").isin(*skip_paths)) if skip_paths else rows


def classified(rows: DataFrame, catalog: Catalog | None = None, body_is_object: bool = True) -> DataFrame:
    """Stateless classification of a stream, row by row (distinct values would need state).

    Levels and details are those of ``classify``, bodies included.
    """
    catalog = catalog or load()
    rows = leveled(method_signals(url_signals(rows, catalog), catalog), catalog, body_is_object)
    return rows.withColumn("source", source_of(F.col("user_agent"), catalog))


def captured(rows: DataFrame, catalog: Catalog | None = None, secret: str | None = None, token_names: tuple[str, ...] = ("token",), sensitive: str = SENSITIVE_KEYS) -> DataFrame:
    """A stream of raw requests as they are stored: classified, addresses checked, chained, redacted.

    Beside the columns of ``classified`` it reads those of these that are there: ``rate_tier, rate_severity,
    rate_count, rate_limit``; ``x_forwarded_for, cf_connecting_ip, cf_ip_country`` (they become
    ``forwarding_chain``); ``cookies`` and ``headers``, maps of text (with a secret, the first token by
    ``token_names`` gives ``user_id`` and ``session_id``, and ``headers`` gives ``origin``); ``response_headers``, a
    map of text (``content_length``, null unless a number); ``started_ms`` and ``finished_ms`` (``response_time_ms``).
    Header names are in lower case. None of them is stored. Bodies are scanned as they
    came and stored redacted. Rows are independent of each other, so there is no state.
    """
    rows = check_addresses(classified(rows, catalog))
    if "rate_tier" in rows.columns:
        rows = add_rate_limits(rows)
    none = F.lit(None).cast("string")
    given = lambda name: F.col(name) if name in rows.columns else none
    rows = rows.withColumn("forwarding_chain", forwarding_chain(*map(given, ("x_forwarded_for", "cf_connecting_ip", "cf_ip_country"))))
    if "request_body" in rows.columns:
        rows = rows.withColumn("request_body", redacted(F.col("request_body"), sensitive))
    if "headers" in rows.columns:
        rows = rows.withColumn("origin", F.try_element_at("headers", F.lit("origin")))
    if "response_headers" in rows.columns:
        rows = rows.withColumn("content_length", F.try_element_at("response_headers", F.lit("content-length")).try_cast("long"))
    if {"started_ms", "finished_ms"} <= set(rows.columns):
        rows = rows.withColumn("response_time_ms", F.col("finished_ms") - F.col("started_ms"))
    if secret is not None:
        claims = token_claims(token_of(given("cookies"), given("headers"), token_names), secret)
        rows = rows.withColumn("__claims", claims).withColumns({"user_id": F.col("__claims.user_id"), "session_id": F.col("__claims.session_id")})
    return rows.drop("__claims", *_TRANSIENT)


def level_windows(rows: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Requests of each level per window; rows later than the watermark are dropped."""
    return rows.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "threat_level").agg(F.count("*").alias("requests")).select("w.start", "w.end", "threat_level", "requests")


class Capture:
    """Micro-batches of captured rows, enriched and stored under ``folder``: ``batch=N``, so that a repeated batch replaces itself.

    The lookups are asked at each batch: they are read again when they are due, and a failed read keeps the
    last good version. Rows get ``ip_location``, ``ip_type`` and ``is_tor``.
    """

    def __init__(self, folder: str, places: Refreshed[Geography], exits: Refreshed[DataFrame], catalog: Catalog | None = None):
        self.folder, self.places, self.exits, self.catalog = folder.rstrip("/"), places, exits, catalog

    def __call__(self, batch: DataFrame, number: int) -> None:
        places, exits = self.places.value(), self.exits.value()
        with Scratch():
            rows = written(batch, "captured")
            enriched(rows, places, exits, self.catalog).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")


class Detector:
    """Micro-batches into a request table, closed epochs into campaign records.

    ``folder`` holds ``requests`` (a folder a batch, so that a repeated batch replaces itself), ``panes`` (the
    batch's requests classified and summed up by epoch) and numbered versions of ``campaigns``. A batch reads its
    own rows; when epochs close, their panes and those that markers still reach back to are merged, and older
    ones go. An epoch is closed when a request that is ``late_ms`` past its end has come; every closed epoch is
    detected once, because a version's number says up to which epoch it goes. A request that comes after its
    epoch was closed stays in ``requests`` and counts in no campaign. So the records do not depend on how
    requests up to ``late_ms`` late are dealt to batches.
    """

    def __init__(self, spark: SparkSession, folder: str, start_ms: int, window_ms: int = WINDOW_MS, min_confidence: float = MIN_CONFIDENCE, late_ms: int = 0, catalog: Catalog | None = None):
        self.spark, self.folder, self.start_ms, self.window_ms, self.min_confidence, self.late_ms = spark, folder.rstrip("/"), start_ms, window_ms, min_confidence, late_ms
        self.catalog = catalog or load()
        self.store = CampaignFolder(spark, f"{self.folder}/campaigns")

    def campaigns(self) -> DataFrame | None:
        return self.store.table()

    def __call__(self, batch: DataFrame, number: int) -> None:
        with Scratch():
            batch.write.mode("overwrite").parquet(f"{self.folder}/requests/batch={number}")
            rows = self.spark.read.schema(batch.schema).parquet(f"{self.folder}/requests/batch={number}")
            done = self.store.version()
            like = self._add_panes(rows, done, number)
            newest = self._newest(rows, number)
            closed = 0 if newest is None else max(0, (newest - self.late_ms - self.start_ms) // self.window_ms)
            if closed > done:
                self._close(done, closed, like)

    def _add_panes(self, rows: DataFrame, done: int, number: int) -> DataFrame:
        kept = classify(rows.where(is_ipv4(F.col("ip"))), self.catalog)
        mine = panes.in_panes(kept, self.start_ms, None, self.window_ms).where(F.col("pane") >= done).withColumn("batch", F.lit(number))
        mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pane", "batch").parquet(f"{self.folder}/panes")
        return mine.limit(0)

    def _newest(self, rows: DataFrame, number: int) -> int | None:
        """The latest time so far. Each batch writes it; all but the last two such notes go."""
        own = rows.agg(F.max(millis(F.col("created_at"))).alias("newest"))
        notes = f"{self.folder}/newest"
        before = self._numbers(notes, "batch")
        if before:
            own = own.unionAll(self.spark.read.schema("newest long").parquet(*[f"{notes}/batch={n}" for n in before])).agg(F.max("newest").alias("newest"))
        newest = own.first()["newest"]
        self.spark.createDataFrame([(newest,)], "newest long").write.mode("overwrite").parquet(f"{notes}/batch={number}")
        self._drop([f"{notes}/batch={n}" for n in sorted(before)[:-1] if n != number])
        return newest

    def _close(self, done: int, closed: int, like: DataFrame) -> None:
        # markers of the epochs before reach into the new ones, hence some epochs more are scored than folded
        first = max(0, done - -(-MARKER_MS // self.window_ms))
        numbers = self._numbers(f"{self.folder}/panes", "pane")
        wanted = [f"{self.folder}/panes/pane={n}" for n in numbers if first <= n < closed]
        read = self.spark.read.option("basePath", f"{self.folder}/panes").parquet(*wanted) if wanted else like
        summed = written(panes.merged(read).withColumn("pane", F.col("pane").cast("long") - first), "panes")
        begin, end = self.start_ms + first * self.window_ms, self.start_ms + closed * self.window_ms
        found = detected(context_of_panes(summed, begin, end, self.window_ms, self.window_ms, self.catalog), self.min_confidence)
        new = found.candidates.withColumn("epoch", F.col("epoch") + first).where(F.col("epoch") >= done)
        old = self.campaigns()
        self.store.put(fold(new, source="live") if old is None else upsert(old, new, source="live"), closed)
        self.store.prune()
        self._drop([f"{self.folder}/panes/pane={n}" for n in numbers if n < closed - -(-MARKER_MS // self.window_ms)])

    def _numbers(self, folder: str, name: str) -> list[int]:
        """Numbers of the folders ``name=N``."""
        where, fs = filesystem(self.spark, folder)
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.rpartition("=")[2]) for n in found if n.startswith(f"{name}="))

    def _drop(self, folders: list[str]) -> None:
        for folder in folders:
            where, fs = filesystem(self.spark, folder)
            fs.delete(where, True)


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``act`` (a detection over closed epochs, a campaign upsert) on every micro-batch."""
    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
