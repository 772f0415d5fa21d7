"""Document fingerprints: a canonical exact digest, with DataFrame and SQL functions only.

The canonical form of a text is its compatibility composition (NFKC) with full case folding and every run of
white space as one space. Two salted 64-bit xxhash values of it make the digest. Texts that share a digest
are compared byte by byte (as canonical forms): where a bucket holds several forms, all but the first get an
ordinal in their fingerprint.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, documents, shuffle_partitions, small, unused, written

#: Bits of each hash value that are used; fewer only to force shared digests in tests.
HASH_BITS = 64
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Runs of white space except single plain spaces, which are as they should be.
_FOLDED = rf" {_SPACE}+|[\s\x1c-\x1f\x85\p{{Z}}&&[^ ]]{_SPACE}*"


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty. Use it as a column of its own, for it is not collapsed."""
    text = F.coalesce(text, F.lit(""))

    def composed(x: Column) -> Column:
        return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    def folded(x: Column) -> Column:
        return F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))

    ascii_only = F.length(text) == F.octet_length(text)  # then composition changes nothing
    form = F.when(ascii_only, F.lower(text)).otherwise(composed(folded(composed(text))))
    return F.trim(F.regexp_replace(form, _FOLDED, " "))


def digest(form: Column, bits: int = HASH_BITS) -> Column:
    """32 hexadecimal digits: xxhash64 under two salts."""

    def half(salt: str) -> Column:
        return F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(F.lit(salt), form), 64 - bits))), 16, "0")

    return F.concat(half("first"), half("second"))


def digests(rows: DataFrame, text_col: str, out: str, bits: int = HASH_BITS) -> DataFrame:
    """``rows`` with the form of ``text_col`` in ``out_form`` and its digest in ``out``."""
    return rows.withColumn(f"{out}_form", canonical(F.col(text_col))).withColumn(out, digest(F.col(f"{out}_form"), bits))


def ordinals(forms: DataFrame) -> DataFrame | None:
    """Compares the bytes of forms inside equal buckets.

    ``forms`` has ``digest, form`` of the texts that share a digest. Returns ``digest, form, ordinal`` for
    buckets with several forms, or None if there is none. The least and greatest form are taken in three
    steps: in the reading task, among about a square root of the tasks, then of those, so that a digest that a
    third of all rows share sends few forms to any one task.
    """
    lots = math.isqrt(shuffle_partitions(forms.sparkSession) - 1) + 1
    lot = F.pmod(F.spark_partition_id(), F.lit(lots))
    bounds = lambda low, high: (F.min(low).alias("low"), F.max(high).alias("high"))
    split = forms.withColumn("lot", lot).groupBy("digest", "lot").agg(*bounds("form", "form")).groupBy("digest").agg(*bounds("low", "high"))
    split = split.where("low <> high").select("digest")
    split = written(split, "fingerprint-split").read()
    n = split.count()
    if not n:
        return None
    distinct = forms.join(small(split, n, BROADCAST_KEYS), "digest").select("digest", "form").distinct()
    return distinct.withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)


def fingerprints(docs: DataFrame, text_col: str = "text", bits: int = HASH_BITS) -> DataFrame:
    """``docs`` with ``fingerprint``: equal for texts with equal canonical forms, different for all others.

    Null counts as empty, empty texts share a fingerprint, an empty table stays empty. All rows and columns
    pass; a column called ``fingerprint`` is replaced.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"]
    own = unused(docs, "__d")
    while unused(docs, f"{own}_form") != f"{own}_form":
        own = f"_{own}"
    ordinal = unused(docs, "__ordinal")
    rows = digests(docs.select(*names), text_col, own, bits)
    shared = written(rows.groupBy(own).count().where("count > 1").select(F.col(own).alias("digest")), "fingerprint-shared").read()
    n = shared.count()
    forms = rows.select(F.col(own).alias("digest"), F.col(f"{own}_form").alias("form")).join(small(shared, n, BROADCAST_KEYS), "digest")
    apart = ordinals(forms) if n else None
    if apart is None:
        return rows.select(*names, F.col(own).alias("fingerprint"))
    apart = apart.select(F.col("digest").alias(own), F.col("form").alias(f"{own}_form"), F.col("ordinal").alias(ordinal))
    return rows.join(apart, [own, f"{own}_form"], "left").select(*names, _numbered(own, ordinal).alias("fingerprint"))


def _numbered(name: str, ordinal: str) -> Column:
    return F.concat(F.col(name), F.when(F.col(ordinal) > 0, F.concat(F.lit("-"), F.col(ordinal).cast("string"))).otherwise(""))


def next_records(records: DataFrame) -> DataFrame:
    """``records`` (distinct ``doc_id, th``, and more) with ``next_id, next_th`` of the next one in order.

    The order is by id, nulls last, then by the text's hash; after the last comes the first. Ranges of the
    order are written with their number, so that only the ranges' first rows meet in one task.
    """
    ranges = records.repartitionByRange(shuffle_partitions(records.sparkSession), F.col("doc_id").asc_nulls_last(), "th").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, "record-order").read()
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    firsts = ranges.groupBy("part").agg(F.min(key).alias("first"))
    in_order = Window.orderBy("part")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(in_order), F.first("first").over(everything)).alias("following"))
    inside = Window.partitionBy("part").orderBy("no_id", "doc_id", "th")
    led = ranges.withColumn("no_id", F.col("doc_id").isNull()).withColumn("lead", F.lead(key).over(inside)).join(F.broadcast(firsts), "part")  # one row a range
    after = F.when(F.col("lead").isNotNull(), F.col("lead")).otherwise(F.col("following"))
    return led.select(*records.columns, after["doc_id"].alias("next_id"), after["th"].alias("next_th"))


def edited_texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id, th, text, edited`` of the records in ``pairs``.

    The last floor(n/2) characters are replaced by the first as many of the next record's text. ``texts`` is
    dealt out by record once and read twice; what travels again is the part of the next text that is used.
    """
    wanted = pairs.select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), "next_id", "next_th")
    given = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["next_id"]) & (texts["th"] == wanted["next_th"]))
    given = given.select("of_id", "of_th", F.expr("substring(text, 1, half)").alias("start"))
    mine = texts.join(pairs.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), "n_chars"), texts["doc_id"].eqNullSafe(F.col("p_id")) & (texts["th"] == F.col("p_th")))
    both = mine.join(given, mine["doc_id"].eqNullSafe(given["of_id"]) & (mine["th"] == given["of_th"]))
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))")
    return both.select("doc_id", "th", "text", F.concat(kept, F.col("start")).alias("edited"))


def edit_stability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = HASH_BITS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (1 if equal, else 0).

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one
    row per input row. Rows that repeat an id and a text are one record in the order, with equal results;
    equal ids with different texts follow each other. A null text is empty; a null id comes last. A single
    record is its own next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    records = texts.select("doc_id", "th", F.length("text").cast("long").alias("n_chars")).groupBy("doc_id", "th", "n_chars").agg(F.count("*").alias("copies"))
    pairs = written(next_records(records), "record-pairs").read()
    repeated = (pairs.agg(F.max("copies").alias("m")).first()["m"] or 0) > 1
    if repeated:
        texts = texts.dropDuplicates(["doc_id", "th"])

    def both_digests(some_texts: DataFrame, some_pairs: DataFrame) -> DataFrame:
        return digests(digests(edited_texts(some_texts, some_pairs), "text", "own", bits), "edited", "changed", bits)

    found = both_digests(texts, pairs).select("doc_id", "th", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "changed")
    found = written(found, "fingerprints").read()
    each = found.select(F.col("own").alias("digest")).unionAll(found.select("changed"))
    shared = written(each.groupBy("digest").count().where("count > 1").select("digest"), "fingerprint-shared").read()
    n_shared = shared.count()
    result = found.withColumns({"own_n": F.lit(0), "changed_n": F.lit(0)})
    if n_shared:
        listed = small(shared, n_shared, BROADCAST_KEYS)
        sharing = reduce(DataFrame.unionAll, [found.join(listed, found[c] == shared["digest"], "left_semi").select("doc_id", "th") for c in ("own", "changed")]).distinct()
        some_pairs = written(pairs.join(sharing.withColumnsRenamed({"doc_id": "s_id", "th": "s_th"}), pairs["doc_id"].eqNullSafe(F.col("s_id")) & (pairs["th"] == F.col("s_th")), "left_semi"), "fingerprint-pairs").read()
        keys = some_pairs.select("doc_id", "th").unionAll(some_pairs.select("next_id", "next_th")).distinct().toDF("k_id", "k_th")
        keys = written(keys, "fingerprint-keys").read()
        picked = texts.join(small(keys, keys.count(), BROADCAST_KEYS), texts["doc_id"].eqNullSafe(F.col("k_id")) & (texts["th"] == F.col("k_th")), "left_semi")
        again = both_digests(picked, some_pairs)
        forms = again.select(F.explode(F.array(F.struct(F.col("own").alias("digest"), F.col("own_form").alias("form")), F.struct(F.col("changed").alias("digest"), F.col("changed_form").alias("form")))).alias("x")).select("x.*")
        apart = ordinals(forms.join(listed, "digest", "left_semi"))
        if apart is not None:
            numbers = again.select("doc_id", "th", "own", "own_form", "changed", "changed_form")
            for c in ("own", "changed"):
                numbers = numbers.join(apart.toDF(c, f"{c}_form", f"{c}_n"), [c, f"{c}_form"], "left")
            numbers = numbers.select(F.col("doc_id").alias("n_id"), F.col("th").alias("n_th"), "own_n", "changed_n")
            result = found.join(numbers, found["doc_id"].eqNullSafe(F.col("n_id")) & (found["th"] == F.col("n_th")), "left")
    result = result.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "edited_sha256", _numbered("own", "own_n").alias("fingerprint"), _numbered("changed", "changed_n").alias("edited_fingerprint"))
    near = result.select(F.col("f_id").alias("x_id"), F.col("f_th").alias("x_th"), F.col("fingerprint").alias("next_fingerprint"))
    out = pairs.join(result, pairs["doc_id"].eqNullSafe(F.col("f_id")) & (pairs["th"] == F.col("f_th")))
    out = out.join(near, out["next_id"].eqNullSafe(F.col("x_id")) & (out["next_th"] == F.col("x_th")))
    if repeated:
        out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_stability(documents(spark, sf_dir))
