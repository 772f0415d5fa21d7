"""Phrase collocations: frequent n-grams whose words come together far more often than their parts would by chance.

Words are numbered lot by lot, then over the whole corpus. N-grams are counted level by level in counting
quotient filters that tasks fill and buckets merge. An n-gram can only be frequent if both its parts that are
one word shorter are: a bit table of those, of bounded size, keeps most others from being counted at all. Its
false hits cost counters, never a phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bit_table import bit_table, held_in
from .common import BATCH_ROWS, bounded_batches, documents, shuffle_partitions, written
from .lots import Numbered, lot_number
from .pieces import sliced
from .quotient_filter import Filter, Ngrams

#: Characters that end a piece of text.
ENDS = ".,;:!?\n\x0b\x0c\r"
_TO_LINE = bytes.maketrans(ENDS.encode(), b"\n" * len(ENDS))
#: Words and distinct words at which a lot is closed.
LOT_WORDS, LOT_VOCABULARY = 1_000_000, 200_000
#: Numbers of a stream, and words of a lot's list, in one row: readers of written tables take 4,096 rows at once.
ROW_WORDS, ROW_VOCABULARY = 2_000, 250
#: Entries at which a task merges its filters, and of a bucket on average.
TASK_ENTRIES, BUCKET_ENTRIES = 500_000, 1_000_000


def word_lots(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Streams of lot-local word numbers (-1 between pieces), and each lot's words by language with their counts.

    Both are cut into short rows; ``part`` is a stream row's place in its lot. Only lists have ``lang``.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, part = 0, 0, 0
        numbers: count = count()
        known: dict[str, Numbered] = {}
        totals = np.zeros(0, dtype=np.int64)

        def closed() -> pa.RecordBatch:
            cut = [(lang, words[a : a + ROW_VOCABULARY]) for lang, words in ((lang, list(found)) for lang, found in known.items()) for a in range(0, len(words), ROW_VOCABULARY)]
            langs = [lang for lang, _ in cut]
            places = [[known[lang][w] for w in words] for lang, words in cut]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lot_number(made)] * len(langs), pa.int64()),
                    pa.nulls(len(langs), pa.int64()),
                    pa.nulls(len(langs), pa.list_(pa.int32())),
                    pa.array(langs, pa.string()),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array([[w.decode() for w in words] for _, words in cut], pa.list_(pa.string())),
                    pa.array([totals[p] for p in places], pa.list_(pa.int64())),
                ],
                names=names,
            )

        for batch in batches:
            for a, b in sliced(batch.column(1)):
                stream: list[int] = []
                for lang, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    if lang not in known:
                        known[lang] = Numbered(numbers)
                    number = known[lang].__getitem__
                    for piece in text.encode().lower().translate(_TO_LINE).split(b"\n"):
                        stream += map(number, piece.split())
                        stream.append(-1)
                flat = np.array(stream, dtype=np.int32)
                counts = np.bincount(flat[flat >= 0])
                grown = np.zeros(max(len(totals), len(counts)), dtype=np.int64)
                grown[: len(totals)] = totals
                grown[: len(counts)] += counts
                totals, held = grown, held + len(flat)
                ends = np.append(np.arange(0, len(flat), ROW_WORDS), len(flat))
                kept, n = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), len(ends) - 1
                yield pa.RecordBatch.from_arrays([pa.array([lot_number(made)] * n, pa.int64()), pa.array(np.arange(part, part + n)), kept, *(pa.nulls(n, t) for t in (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())))], names=names)
                part += n
                if held >= LOT_WORDS or len(totals) >= LOT_VOCABULARY:
                    yield closed()
                    made, held, numbers, known, totals = made + 1, 0, count(), {}, np.zeros(0, dtype=np.int64)
        if len(totals):
            yield closed()

    schema = "lot long, part long, stream array<int>, lang string, numbers array<int>, words array<string>, counts array<long>"
    names = ["lot", "part", "stream", "lang", "numbers", "words", "counts"]
    return rows.mapInArrow(run, schema)


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id``: gapless from 1. Each written part's rows follow those of the parts before it."""
    rows = written(words.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "vocabulary").read()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("row").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(offsets), "part").withColumn("id", F.col("offset") + place + 1).drop("part", "row", "offset")  # one row a shuffle partition


def id_streams(streams: DataFrame, ids: DataFrame, longest: int) -> DataFrame:
    """Streams of corpus-wide ids (``ids``: of_lot, number, id, 0 for infrequent words); 0 between pieces and for those, once in a row.

    A row's n-grams of up to ``longest`` words are those that start at its first ``own`` places; what follows is
    the next row's begin, then a 0.
    """

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        number, own = right.column("number").to_numpy(), right.column("id").to_numpy()
        flat = left.sort_by("part").column("stream").combine_chunks().flatten().to_numpy()
        most = int(max(number.max(initial=-1), flat.max(initial=-1))) + 1
        of = np.zeros(most + 1, dtype=np.int32)  # the last is for -1
        of[number] = own
        x = of[flat]
        x = x[(x != 0) | (np.concatenate([[0], x[:-1]]) != 0)]
        starts = range(0, len(x), ROW_WORDS)
        rows = [np.append(x[a : a + ROW_WORDS + longest - 1], np.int32(0)) for a in starts]
        return pa.table([pa.array(rows, pa.list_(pa.int32())), pa.array([min(ROW_WORDS, len(x) - a) for a in starts], pa.int32())], names=["ids", "own"])

    return streams.groupBy("lot").cogroup(ids.groupBy("of_lot")).applyInArrow(resolve, "ids array<int>, own int")


def _windows(ids: np.ndarray, words: int) -> np.ndarray:
    """Places at which so many words follow each other."""
    n = max(0, len(ids) - words + 1)
    return reduce(np.logical_and, (ids[k : k + n] != 0 for k in range(words)))


def frequent_ngrams(streams: DataFrame, words: int, bits: int, least: int, buckets: int, shorter: np.ndarray | None) -> DataFrame:
    """``ids, f, mark`` of all n-grams of ``words`` words that occur at least ``least`` times.

    ``shorter`` is the bit table of frequent n-grams of one word less, or None to count all.
    """
    grams, parts = Ngrams(words, bits), Ngrams(max(2, words - 1), bits)
    bucket_bits = min((buckets - 1).bit_length(), grams.limb_widths[0])
    table = streams.sparkSession.sparkContext.broadcast(shorter)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: list[Filter] = []

        def merged() -> list[tuple[int, bytes]]:
            return Filter.merged(filters).buckets(grams, bucket_bits)

        def rows(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(found), 1_000):
                some = found[k : k + 1_000]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["bucket", "filter"])

        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                ids, own = (c.slice(a, BATCH_ROWS) for c in batch.columns)
                x, length = ids.flatten().to_numpy(), ids.value_lengths().to_numpy()
                in_row = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
                at = np.flatnonzero(_windows(x, words))
                at = at[in_row[at] < np.repeat(own.to_numpy(), length)[at]]
                if table.value is not None and len(at):
                    begins = np.flatnonzero(_windows(x, words - 1))
                    marks = parts.marks(parts.permuted([x[begins + k] for k in range(words - 1)]))
                    ok = np.zeros(len(x) + 1, dtype=bool)
                    ok[begins] = held_in(table.value, marks)
                    at = at[ok[at] & ok[at + 1]]
                if len(at):
                    filters.append(Filter.of(grams.permuted([x[at + k] for k in range(words)])))
                if sum(map(len, filters)) >= TASK_ENTRIES:
                    filters[:] = [Filter.merged(filters)]
                    if len(filters[0]) >= TASK_ENTRIES // 2:
                        yield from rows(merged())
                        filters.clear()
        if filters:
            yield from rows(merged())

    def summed(key: tuple, found: pa.Table) -> pa.Table:
        number = key[0].as_py()
        total = Filter.merged([Filter.read(number, x.as_py(), grams, bucket_bits) for x in found.column("filter")])
        kept = total.counts >= least
        limbs = [x[kept] for x in total.limbs]
        ids = grams.ids(limbs)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(ids.reshape(-1)), words).cast(pa.list_(pa.int64())), pa.array(total.counts[kept]), pa.array(grams.marks(limbs))]
        return pa.table(arrays, names=["ids", "f", "mark"])

    return streams.select("ids", "own").mapInArrow(counted, "bucket long, filter binary").groupBy("bucket").applyInArrow(summed, "ids array<long>, f long, mark long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score.

    A phrase has 2 to ``longest`` words of one piece of text and occurs ``a >= least`` times in its language. Its
    score is the lowest over its cuts of floor(1000 a n / (l r)), with the counts of both parts and of all words;
    it is dropped if a longer candidate that contains it has ``percent`` of its count. Ties go to the earlier
    cut, the larger count, then the phrase's bytes. Null texts are empty, a null language is ``und``, repeated
    rows each count, texts are read whole and an empty table has no phrases. Other columns do not pass.

    1000 a n must stay below 10^38. Corpora of over 2^31 frequent words do not fit.
    """
    lots = written(word_lots(docs, text_col, lang_col), "word-lots").read()
    lists = lots.where("lang is not null")
    size = F.expr("aggregate(counts, 0L, (x, y) -> x + y)")
    totals = written(lists.groupBy("lang").agg(F.sum(size).alias("n")), "word-totals").read()
    listed = lists.select("lot", "lang", F.explode(F.arrays_zip("numbers", "words", "counts")).alias("x")).select("lot", "lang", "x.*")
    known = listed.groupBy("lang", "words").agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    vocabulary = written(numbered(known.withColumnRenamed("words", "word")), "word-ids").read()
    n_words = vocabulary.count()
    ids = vocabulary.select("lang", F.col("word").alias("words"), "id")
    of_lot = listed.join(ids, ["lang", "words"], "left").select(F.col("lot").alias("of_lot"), F.col("numbers").alias("number"), F.coalesce("id", F.lit(0)).cast("int").alias("id"))
    streams = written(id_streams(lots.where("lang is null").select("lot", "part", "stream"), of_lot, longest), "word-streams").read()
    everything = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * shuffle_partitions(docs.sparkSession), math.ceil(everything / BUCKET_ENTRIES))
    found, shorter = [], None
    for words in range(2, longest + 1):
        level = written(frequent_ngrams(streams, words, max(1, n_words.bit_length()), least, buckets, shorter), f"phrases-{words}").read()
        found.append(level)
        n = level.count()
        if not n:
            break
        shorter = bit_table(level, n)
    phrases = written(reduce(DataFrame.unionAll, [x.select("ids", "f") for x in found]), "phrases").read()
    return _ranked(phrases, vocabulary.join(totals, "lang"), longest, top, percent)


def _ranked(phrases: DataFrame, vocabulary: DataFrame, longest: int, top: int, percent: int) -> DataFrame:
    """The first phrases of each language (``phrases``: ids, f of the frequent ones; ``vocabulary``: id, lang, word, f, n)."""
    size = F.size("ids")
    shorter = phrases.where(size > 2).select(F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"), F.col("f").alias("longer"))
    shorter = shorter.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = phrases.join(shorter, "ids", "left").where(F.coalesce("longer", F.lit(0)) * 100 < F.col("f") * percent).select("ids", F.col("f").alias("a"))
    parts = phrases.select(F.col("ids").alias("part"), "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n"))
    parts = parts.unionByName(vocabulary.select(F.array("id").alias("part"), "f", "lang", "n"))
    cuts = F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")
    sides = kept.select("ids", "a", cuts).select("ids", "a", F.explode(F.array(*[F.struct("cut", F.lit(k).alias("side"), side.alias("part")) for k, side in enumerate((F.expr("slice(ids, 1, cut)"), F.expr("slice(ids, cut + 1, size(ids) - cut)")))])).alias("x"))
    sides = sides.select("ids", "a", "x.*").join(parts, "part")
    both = [F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"{'lr'[s]}{c}") for c in range(1, longest) for s in (0, 1)]
    wide = sides.groupBy("ids", "a").agg(F.max("lang").alias("lang"), F.max("n").alias("n"), *both)
    exact = "1000BD * cast(a as decimal(20,0)) * cast(n as decimal(20,0)) div (cast(l{0} as decimal(19,0)) * cast(r{0} as decimal(19,0)))"
    options = [F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(exact.format(c)).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, longest)]
    lowest = F.least(*options) if len(options) > 1 else options[0]
    scored = wide.select("ids", "lang", "a", "n", lowest.alias("x")).select("ids", "lang", "a", "n", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    spelled = near.select("*", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    spelled = spelled.groupBy("ids", "lang", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = spelled.withColumn("phrase", F.array_join(F.col("words.word"), " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), sizes as (
  select lang, sum(len(ws)) as n from words group by lang
), starts as (
  select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from words, (select unnest(range(1, 6)) as k) where len(ws) >= k
), frequent as (
  select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase, count(*) as f from starts group by all having count(*) >= 100
), longer as (
  select lang, phrase, max(f) as most from (
    select lang, f, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) as phrase
    from (select lang, k, f, string_split(phrase, ' ') as w from frequent where k > 2)
  ) group by lang, phrase
), kept as (
  select c.lang, c.k, c.phrase, c.f as a, string_split(c.phrase, ' ') as w
  from frequent c left join longer x on x.lang = c.lang and x.phrase = c.phrase
  where c.k >= 2 and (x.most is null or 100 * x.most < 100 * c.f)
), cuts as (
  select lang, k, phrase, a, c, array_to_string(w[1 : c], ' ') as p, array_to_string(w[c + 1 : k], ' ') as q
  from (select *, unnest(range(1, k)) as c from kept)
), scored as (
  select u.lang, u.phrase, u.a, x.f as l, y.f as r, s.n, u.c, (1000::hugeint * u.a * s.n) // (x.f::hugeint * y.f) as score
  from cuts u join frequent x on x.lang = u.lang and x.phrase = u.p
    join frequent y on y.lang = u.lang and y.phrase = u.q join sizes s on s.lang = u.lang
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
