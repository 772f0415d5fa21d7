"""Collocations against plain counting and SQL; quotient filters against dictionaries."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from gatewatch.llm import bit_table, collocations
from gatewatch.llm.quotient_filter import Filter, Ngrams


@pytest.mark.parametrize(("words", "bits"), [(2, 1), (2, 18), (3, 18), (4, 16), (4, 20), (5, 13), (5, 32), (2, 32)])
@pytest.mark.parametrize("bucket_bits", [0, 1])
def test_filters_keep_every_count(words, bits, bucket_bits):
    rng = np.random.default_rng(words * 100 + bits)
    grams = Ngrams(words, bits)
    want, filters = Counter(), []
    for _ in range(3):
        few = rng.integers(0, 1 << bits, (40, words))
        some = np.concatenate([few[rng.integers(0, 40, 900)], rng.integers(0, 1 << bits, (500, words)), few[:1].repeat(300, 0)])
        want.update(map(tuple, some.tolist()))
        limbs = grams.permuted([some[:, k] for k in range(words)])
        assert (grams.ids(limbs) == some).all()
        filters.append(Filter.of(limbs))
    merged = Filter.merged(filters)
    assert dict(zip(map(tuple, grams.ids(merged.limbs).tolist()), merged.counts.tolist())) == want
    back = Filter.merged([Filter.read(n, data, grams, bucket_bits) for f in filters for n, data in f.buckets(grams, bucket_bits)])
    assert all((x == y).all() for x, y in zip(back.limbs, merged.limbs)) and (back.counts == merged.counts).all()
    for n, data in merged.buckets(grams, bucket_bits):
        again = Filter.read(n, data, grams, bucket_bits)
        assert all((np.diff(x.astype(object)) >= 0).all() for x in again.limbs[:1])


def by_hand(rows, least, longest, top, percent=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    candidates = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    out = []
    for (lang, *w), a in candidates.items():
        if any(x[0] == lang and len(x) > len(w) + 1 and 100 * c >= percent * a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x) - len(w) + 1)) for x, c in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], k + 1, *x[1:]) for k, x in enumerate(mine[:top])]
    return sorted(ranked)


def texts(n=260, seed=2):
    rng = random.Random(seed)
    words = ["Tea", "tea", "cup", "of", "the", "été", "x\x85y", "日本", "É", "\x1ca"]
    phrases = ["green tea cup of the day", "New York", "of the of the", "à la carte", "cup of tea"]
    out = []
    for k in range(n):
        parts = [rng.choice(words) if rng.random() < 0.6 else rng.choice(phrases) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!\r\n", ";"]) for p in parts)
        out.append((text, ["aa", "bb", None, "und"][k % 4]))
    return [*out, (None, None), ("", "aa"), (" \t.,", "cc"), ("hot hot " * 700, "hot"), ("tail", "bb")]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("least", "longest", "top", "percent"), [(12, 5, 2000, 100), (5, 4, 7, 80), (30, 2, 3, 100)])
def test_against_plain_counting(spark, monkeypatch, least, longest, top, percent):
    for name, value in (("LOT_WORDS", 700), ("TASK_ENTRIES", 300), ("BUCKET_ENTRIES", 500)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, word string, id int").repartition(3)
    got = collocations.collocations(df, least=least, longest=longest, top=top, percent=percent)
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, least, longest, top, percent)


def test_empty_tables_and_a_full_bit_table(spark, monkeypatch):
    df = spark.createDataFrame(texts(), "text string, lang string")
    assert collocations.collocations(df.limit(0)).collect() == []
    assert collocations.collocations(df.where("text is null")).collect() == []
    monkeypatch.setattr(bit_table, "MOST_BITS", 64)  # every n-gram passes it
    assert sorted(map(tuple, collocations.collocations(df, least=12).collect())) == by_hand(texts(), 12, 5, 2000)


def test_query_against_sql(spark, tmp_path):
    rows = [r for r in texts(900, seed=6)]
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collocations.op12_collocations(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(collocations.OP12_SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    phrases = spark.createDataFrame([([1, 2], big)], "ids array<long>, f long")
    words = spark.createDataFrame([(1, "aa", "x", big + 1, 7 * big), (2, "aa", "y", big + 3, 7 * big)], "id long, lang string, word string, f long, n long")
    row = collocations._ranked(phrases, words, 5, 2000, 100).first()
    assert row.score == 1000 * big * 7 * big // ((big + 1) * (big + 3)) and row.phrase == "x y"


def test_rows_of_written_tables_are_short(spark, monkeypatch):
    """Readers take thousands of rows at once: no row holds a lot, and no n-gram is lost or counted twice where rows end."""
    for name, value in (("LOT_WORDS", 700), ("ROW_WORDS", 7), ("ROW_VOCABULARY", 5)):
        monkeypatch.setattr(collocations, name, value, raising=False)
    kept, real = {}, collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    rows = texts()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(df, least=12).collect())) == by_hand(rows, 12, 5, 2000)
    sizes = kept["word-lots"].read().selectExpr("max(size(stream)) as s", "max(size(words)) as w").first()
    assert (sizes.s, sizes.w) == (7, 5)
    assert kept["word-streams"].read().selectExpr("max(size(ids)) as s").first().s <= 7 + 4 + 1
