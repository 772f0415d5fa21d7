"""JSON dumps that are one object, however large, read by all tasks.

The file is cut at every closing brace, which Spark's text reader does within byte ranges. Whether a piece
begins inside a string follows from the number of quotes before it, and how deep it is nested from the brackets
outside of strings before it: both are prefix sums, within a byte range and over the ranges' totals. A request
ends where a brace brings the depth back to that of the list; the pieces up to there are put together again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written

#: Depth of the list in ``{"logs_requests": [...]}``.
_LIST_DEPTH = 2
_HEAD = r'\s*\{\s*"logs_requests"\s*:\s*\['


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all pieces before, in ranges' order and then the pieces'."""
    rows = rows.withColumn("__value", value)
    inside = Window.partitionBy("range").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(F.sum("__value").alias("total"))  # one row for each byte range of the file
    starts = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("__start"))
    summed = rows.withColumn(name, F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(F.broadcast(starts), "range")
    return summed.withColumn(name, F.col(name) + F.col("__start")).drop("__value", "__start")


def _brackets(text: Column, in_string: Column) -> Column:
    """Opening less closing brackets outside of strings. ``text`` has no escapes."""
    outside = F.array_join(F.filter(F.split(text, '"', -1), lambda _, k: k % 2 == in_string.cast("int")), "")
    return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``range, piece, text`` of a file cut at its closing braces, which are left out; the last piece is not cut."""
    read = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("piece"), F.col("value").alias("text"))
    return written(read, "dump-pieces")


def requests_of(spark: SparkSession, path: str) -> DataFrame:
    """``request``: the JSON text of each member of the list, in no order.

    The path is one file, of one such object or of one after another. Braces, quotes and escapes in strings are
    told from the dump's own. An error if it does not begin with the list, or if it ends within a request.
    """
    rows = pieces(spark, path)
    first = rows.orderBy("range", "piece").select("text").first()
    if first is None or not re.match(_HEAD, first.text):
        raise ValueError("the dump has no list of requests")
    rows = rows.withColumn("__plain", F.regexp_replace("text", r"(?s)\\.", ""))
    rows = _running(rows, F.length("__plain") - F.length(F.replace(F.col("__plain"), F.lit('"'), F.lit(""))), "quotes")
    in_string = F.col("quotes") % 2 == 1
    ends_in_string = (F.size(F.split("__plain", '"', -1)) - 1 + F.col("quotes")) % 2 == 1
    rows = rows.withColumns({"__depth": _brackets(F.col("__plain"), in_string) - F.when(ends_in_string, 0).otherwise(1), "ends_in_string": ends_in_string}).drop("__plain")
    rows = _running(rows, F.col("__depth"), "depth")
    rows = rows.withColumn("ends", (F.col("depth") + F.col("__depth") == _LIST_DEPTH) & ~F.col("ends_in_string"))
    rows = _running(rows, F.col("ends").cast("int"), "request")
    parts = F.sort_array(F.collect_list(F.struct("range", "piece", "text")))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "}")
    grouped = written(rows.groupBy("request").agg(joined.alias("text"), F.max("ends").alias("whole")), "dump-requests")
    rest = [r.text for r in grouped.where("NOT whole").select("text").collect()]  # one group at most: what follows the last request
    if len(rest) != 1 or not re.fullmatch(rf"(({_HEAD})?\s*\]\s*(\}}\s*)?)+", rest[0]):
        raise ValueError("the dump ends within a request")
    between = rf"^([\s,\]}}]*{_HEAD})*[\s,]*"
    return grouped.where("whole").select(F.concat(F.regexp_replace("text", between, ""), F.lit("}")).alias("request"))
