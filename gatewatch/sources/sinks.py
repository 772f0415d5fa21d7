"""Where results go."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import campaigns as records
from ..tables import filesystem


def append_requests(rows: DataFrame, path: str) -> None:
    """Adds requests to a table partitioned by day, so that time windows prune folders."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


#: Requests in one object of a dump.
DUMP_ROWS = 1_000


def write_dump(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines ``{"logs_requests": [...]}`` that ``read_dump`` takes back.

    Nested columns are text and times ISO strings. A line holds ``DUMP_ROWS`` rows at most.
    """
    nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    iso = F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    flat = rows.withColumns({**{c: F.to_json(c) for c in nested}, "created_at": iso})
    arrived = F.monotonically_increasing_id()
    chunks = flat.select(F.struct(arrived.alias("at"), F.struct(*flat.columns).alias("row")).alias("x")).groupBy(F.floor(F.col("x.at") / DUMP_ROWS).alias("chunk"))
    lists = chunks.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias("logs_requests"))
    lists.select("logs_requests").write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report(candidates: DataFrame) -> DataFrame:
    """Fires as a report shows them: with ``times_fired`` (of the identifier so far) and ``outcome``, most confident first."""
    so_far = F.row_number().over(Window.partitionBy("identifier").orderBy("epoch"))
    rows = candidates.withColumn("times_fired", so_far)
    outcome = F.when(F.col("times_fired") > 1, "updated").otherwise("inserted")
    return rows.withColumn("outcome", outcome).orderBy(F.col("confidence").desc(), "identifier", "epoch")


def report_lines(candidates: DataFrame, form: str = "table") -> DataFrame:
    """The report's text in ``line``: a paragraph a fire, or with ``form`` ``jsonl`` one JSON object a line."""
    rows = report(candidates)
    if form == "jsonl":
        return rows.select("confidence", F.to_json(F.struct(*rows.columns)).alias("line"))
    if form != "table":
        raise ValueError("a report is a table or jsonl")
    shown = lambda v: F.when(v.rlike(r"^-?\d+\.\d+(E-?\d+)?$"), F.format_string("%.3f", v.cast("double"))).otherwise(v)
    pairs = F.map_entries(F.from_json("evidence", "map<string,string>"))
    facts = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), shown(e["value"]))), " ")
    head = F.format_string("%.3f  %s", "confidence", "identifier")
    again = F.format_string("%s  (re-fire #%d)", head, "times_fired")
    span = F.concat_ws(" -> ", *[F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") for c in ("first_seen", "last_seen")])
    paths = F.concat(F.lit("paths: "), F.array_join(F.slice("sample_paths_probed", 1, 3), ", "))
    return rows.select("confidence", F.when(F.col("outcome") == "updated", again).otherwise(F.concat_ws("\n        ", head, facts, span, paths)).alias("line"))


def rendered(campaigns: DataFrame) -> DataFrame:
    """Lines of campaign records, the most confident first."""
    again = F.when(F.col("times_fired") > 1, F.concat(F.lit(" (re-fire #"), (F.col("times_fired") - 1).cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(F.format_string("%.3f ", F.col("confidence")), F.rpad("campaign_threat_level", 7, " "), "identifier", again)
    return campaigns.select("confidence", "identifier", line.alias("line")).orderBy(F.col("confidence").desc(), "identifier")


def dry_run(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first rows, and how many there are of each level."""
    return rows.orderBy("created_at", "ip").limit(3), rows.groupBy("threat_level").agg(F.count("*").alias("requests"))


class CampaignStore(Protocol):
    """Where campaign records live. A store of one's own has these three methods."""

    def upsert(self, found: DataFrame, source: str) -> DataFrame:
        """Takes candidates in; ``identifier`` and ``outcome`` (inserted or updated) of their records."""

    def find_open(self, identifier: str) -> DataFrame: ...

    def by_status(self, status: str) -> DataFrame: ...


class CampaignFolder:
    """Campaign records as numbered Parquet versions in a folder; an unfinished version does not count.

    One writer at a time. Versions before the last stay, for readers that still use them, until ``prune``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The newest whole version; 0 without one."""
        where, fs = filesystem(self.spark, self.folder)
        if not fs.exists(where):
            return 0
        whole = [s.getPath() for s in fs.listStatus(where) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max([int(p.getName().rpartition("=")[2]) for p in whole], default=0)

    def table(self, version: int | None = None) -> DataFrame | None:
        """All records of a version (the newest if none is given), or none if nothing was stored yet."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.folder}/version={version}") if version else None

    def put(self, table: DataFrame, version: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def prune(self, keep: int = 2) -> None:
        """Only the newest versions stay, for readers of the one before the last."""
        where, fs = filesystem(self.spark, self.folder)
        found = sorted((int(s.getPath().getName().rpartition("=")[2]), s.getPath()) for s in fs.listStatus(where))
        for _, old in found[:-keep]:
            fs.delete(old, True)

    def _records(self) -> DataFrame:
        table = self.table()
        if table is None:
            raise LookupError(f"no campaigns in {self.folder}")
        return table

    def upsert(self, found: DataFrame, source: str) -> DataFrame:
        version, old = self.version(), self.table()
        self.put(records.fold(found, source=source) if old is None else records.upsert(old, found, source=source), version + 1)
        mine = found.select("identifier").distinct()
        if old is None:
            return mine.withColumn("outcome", F.lit("inserted"))
        known = old.where((F.col("status") != "closed") & (F.col("source") == source)).select("identifier").distinct().withColumn("__known", F.lit(True))
        return mine.join(known, "identifier", "left").select("identifier", F.when(F.col("__known"), "updated").otherwise("inserted").alias("outcome"))

    def find_open(self, identifier: str) -> DataFrame:
        return records.find_open(self._records(), identifier)

    def by_status(self, status: str) -> DataFrame:
        return records.by_status(self._records(), status)
