"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source the key's range is cut into about sqrt(n) cells,
so that both the rows of a cell and the cells of a source stay small at any size: a hot source spreads over
many cells. Cell sums give each cell's offset, a window inside the cell gives each document's, and the
source's exact budget cuts the order: whole epochs first, then a prefix of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, picked, row_key, small, unused, written

#: Most distinct sources that are broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 20_000
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Equal rows that one output task lists at most.
LISTED = 100_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Column | None = None) -> DataFrame:
    """Adds ``weight`` and ``target`` to rows ``source, source_size``.

    Targets share all sizes by weight and stop at ``MAX_EPOCHS`` times their source's size; the excess goes
    to the others by weight until none is above. Sorted by limit / weight, the sources at their limit are a
    prefix, so running sums find it without iteration.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    if weights is None:
        weights = (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double")
    first = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, everything = first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weights)
        .withColumn("limit", F.col("source_size") * F.lit(float(MAX_EPOCHS)))
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
        .withColumn("full", F.col("full_at") <= F.col("level"))
        .withColumn("open_level", F.min(F.when(~F.col("full"), F.struct("full_at", "level"))).over(everything)["level"])
    )
    return ranked.select("source", "rows", "source_size", "weight", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.col("open_level")).alias("target"))


def placed(docs: DataFrame, size: Column, id_col: str, source_col: str, row_col: str | None, seed: str) -> DataFrame:
    """Groups of rows that share source, id, size and ``row``, with their place in the source's order.

    ``doc_id, source, size, row, copies, source_size, target, epochs, left``: ``left`` is what the last,
    unfinished epoch's budget has left before the group's first row. Equal rows collapse before any window, so
    many rows without an id, or with one id, are few rows here.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    row = F.col(row_col) if row_col else F.lit(None).cast("string")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), row.alias("row"))
    grouped = sized.groupBy("doc_id", "source", "size", "key", "row").agg(F.count("*").alias("copies"))
    grouped = written(grouped, "mix-sizes").read()
    sources = grouped.groupBy("source").agg(F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = written(targets(sources), "mix-targets").read()
    n_sources = sources.count()
    at = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(16**13)
    aimed = small(sources.withColumnRenamed("source", "of"), n_sources, BROADCAST_SOURCES)
    joined = grouped.join(aimed, grouped["source"].eqNullSafe(aimed["of"])).drop("of", "weight")
    celled = joined.withColumns({"cell": F.floor(at * F.ceil(F.sqrt("rows"))).cast("long"), "held": F.col("size") * F.col("copies")})
    cells = celled.groupBy("source", "cell").agg(F.sum("held").alias("cell_size"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("of"), F.col("cell").alias("c"), F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "cell").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    found = celled.withColumn("within", F.coalesce(F.sum("held").over(inside), F.lit(0)))
    found = found.join(cells, found["source"].eqNullSafe(cells["of"]) & (found["cell"] == cells["c"]))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    found = found.withColumn("epochs", epochs)
    left = budget - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("within")
    return found.select("doc_id", "source", "size", "row", "copies", "source_size", "target", "epochs", left.cast("long").alias("left"))


def _listed(groups: DataFrame) -> DataFrame:
    """One row per copy, numbered from 0 in ``nth``. Very large groups are dealt out in blocks first."""
    groups = written(groups, "mix-groups").read()
    most = groups.agg(F.max("copies").alias("m")).first()["m"] or 0
    if most <= 1:
        return groups.withColumn("nth", F.lit(0).cast("long"))
    if most > LISTED:
        groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(LISTED).cast("long")))).repartition("doc_id", "source", "block")
    else:
        groups = groups.withColumn("block", F.lit(0).cast("long"))
    return groups.withColumn("nth", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + LISTED, F.col("copies")) - 1))).drop("block")


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, epochs, taken``.

    ``epochs`` counts whole passes over the document's source, ``taken`` the size units the mix takes of this
    document, repeats counted: each source yields ``floor(target)`` exactly, cutting the document at the
    budget's end. A null source is a source of its own (last in order). Rows that share an id are ordered by
    size and then indistinguishable; a null id is an id. Sources of size 0 take nothing. Empty tables give
    empty results; other columns are not read.
    """
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("nth") * F.col("size"))).cast("long")
    rows = _listed(placed(docs, size, id_col, source_col, None, seed))
    return rows.select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))


def mixed(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    Documents stay whole here: the one that the budget's end falls into is taken once more if at least half of
    it lies within the budget, so a source misses its target by half a document at most. Rows are told apart
    by all their columns, so null or repeated ids neither multiply nor lose rows; documents of size 0 come once
    in each whole epoch. Order and targets are those of :func:`mix`; of rows with one id and size, a hash of the row decides.
    """
    row = unused(docs, "__row")
    keyed = docs.withColumn(row, row_key(docs))
    groups = placed(keyed, size, id_col, source_col, row, seed)
    entire = F.greatest(F.lit(0), F.least(F.col("copies"), F.floor(F.col("left") / F.col("size"))))
    cut = F.col("left") - entire * F.col("size")
    more = F.when((entire < F.col("copies")) & (cut * 2 >= F.col("size")), 1).otherwise(0)
    times = (F.col("epochs") * F.col("copies") + F.when(F.col("size") > 0, entire + more).otherwise(F.lit(0))).cast("long")
    names = {x: unused(keyed, x) for x in ("__times", "__block", "__nth")}
    t, block, nth = names.values()
    kept = groups.select(F.col("row").alias(row), "copies", times.alias(t)).where(F.col(t) > 0)
    out = picked(keyed, written(kept, "mix-kept").read(), row)
    blocks = F.sequence(F.lit(0).cast("long"), F.col(t) - 1, F.lit(LISTED).cast("long"))
    repeated = F.sequence(F.col(block), F.least(F.col(block) + LISTED, F.col(t)) - 1)
    return out.withColumn(block, F.explode(blocks)).withColumn(nth, F.explode(repeated)).select(*docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim, (source_size * 3.0::DOUBLE) / weight AS full_at,
         (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights FROM sources),
leveled AS (
  SELECT *, (total - coalesce(sum(lim) OVER b, 0)) / (weights - coalesce(sum(weight) OVER b, 0)) AS level
  FROM ranked WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, CASE WHEN full_at <= level THEN lim
         ELSE weight * (SELECT level FROM leveled WHERE full_at > level ORDER BY full_at LIMIT 1) END AS target
  FROM leveled),
placed AS (
  SELECT s.*, a.source_size, a.target, floor(a.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
