"""The registered queries against plain Python, on one small table with nulls, copies, ties and long texts."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from gatewatch.llm import language, quality, substrings, toxicity
from gatewatch.llm.queries import ORACLE_SQL, QUERIES
from gatewatch.llm.samples import labelled_texts
from pyspark.sql import functions as F
from test_jaccard_join import brute
from test_models import prose
from test_substrings import by_hand

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(12)
    out = []
    for k in range(260):
        text = prose(rng, rng.choice(["aa", "bb", "cc"]), rng.randint(1, 90))
        if k % 7 == 3:
            text = f"{text} zwurk gloppig {text}"
        if k % 9 == 4:
            text = text.upper().replace(" ", "!! ")
        out.append((k * 3, text, ["aa", "bb", None][k % 3], f"s{k % 4}" if k % 5 else None))
    base = out[20][1]
    out += [(2_000 + k, base if k % 2 else base.replace(" ", "  "), "aa", "s1") for k in range(9)]
    out += [(2_100 + k, f"{out[30][1]} tail{k}", "bb", "s2") for k in range(6)]
    out += [(3_000, None, None, None), (3_001, "", "aa", "s0"), (3_002, " \t\n", "aa", "s0"), (3_003, "12 34 !!", None, "s0"), (3_004, "日本語 Straße ÉTÉ\x85ﬁ", None, "s0"), (3_005, prose(rng, "aa", 9_000), "aa", "s3")]
    return out


ROWS = rows()
LABELS = [(d, int(k % 9 != 4), int(k % 7 == 3)) for k, (d, *_) in enumerate(ROWS[:260])] + [(0, None, None), (9_999, 1, 1)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def result(spark, sf, name):
    df = QUERIES[name](spark, sf)
    found = df.collect()
    return df, found


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, sf):
    df, got = result(spark, sf, "op1_sharding")
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len((t or "").encode()) + 8, crc32((t or "").encode())) for d, t, *_ in ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None} and set(by) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_op3(spark, sf):
    _, got = result(spark, sf, "op3_language")
    out = {d: crc32(str(d).encode()) % 3 == 1 for d, *_ in ROWS}
    texts = defaultdict(list)
    for d, t, lang, _ in ROWS:
        if t is not None and lang and not out[d]:
            texts[lang].append(t)
    filled = {}
    for lang, some in texts.items():
        n = defaultdict(int)
        for t in some:
            for g in language._distinct_grams(t).tolist():
                n[g] += 1
        least = max(2, len(some) * language.LEAST_SHARE) if len(some) >= language.FEW_ROWS else 1
        top = sorted((g for g in n if n[g] >= least), key=lambda g: (-n[g], np.uint64(g).view(np.int64)))[: language.GRAMS_PER_LANGUAGE]
        filled[lang] = np.array(top, dtype=np.uint64)
    model = language.LanguageFilter(filled)
    want = {d: model.predict(t) for d, t, *_ in ROWS}
    assert {r.doc_id: (r.lang_pred, r.score) for r in got} == want and len(got) == len(ROWS)
    assert {r.doc_id: r.held_out for r in got} == out
    assert [want[d][0] for d in (3_000, 3_001, 3_002, 3_003)] == ["und"] * 4


@pytest.mark.parametrize(("name", "label", "cut", "module"), [("op4_toxicity", "toxic", 0.5, toxicity), ("op9_quality", "quality", 0.3, quality)])
def test_op4_and_op9(spark, sf, name, label, cut, module):
    _, got = result(spark, sf, name)
    out = {d: crc32(str(d).encode()) % 5 == 0 for d, *_ in ROWS}
    assert {r.doc_id: r.held_out for r in got} == out and len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = labelled_texts(docs, labels, label, F.lit(True) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    index = 1 if label == "quality" else 2
    assert sorted(learned) == sorted((dict((r[0], r[1]) for r in ROWS)[x[0]], x[index]) for x in LABELS[:260] if not out[x[0]])
    model = module.fit_on(docs, labels)
    by_text = (lambda t: float(toxicity.Scorer(model).scores([t])[0])) if module is toxicity else (lambda t: model.score(quality.Grams().of(t)))
    for r in got[:40]:
        text = next(t for d, t, *_ in ROWS if d == r.doc_id)
        assert r.score == pytest.approx(by_text(text or ""), abs=1e-5)
    truth = {x[0]: x[index] for x in LABELS[:260]}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.85


def test_op5(spark, sf):
    _, got = result(spark, sf, "op5_substrings")
    want = by_hand([(d, t) for d, t, *_ in ROWS], substrings.PASSAGE_CHARS)
    assert sorted(((r.doc_id, r.start, r.n_chars, r.kept, r.inside) for r in got), key=repr) == want and want


def test_op6(spark, sf):
    _, got = result(spark, sf, "op6_jaccard_join")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute([(d, t) for d, t, *_ in ROWS], 4, 85)


def test_op8(spark, sf):
    _, got = result(spark, sf, "op8_fingerprints")
    by = {r.doc_id: r for r in got}
    assert len(by) == len(got) == len(ROWS)
    ordered = sorted(ROWS)
    for (d, t, *_), (e, u, *_) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u, r = t or "", u or "", by[d]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert r.near_edited == float(r.fingerprint == r.edited_fingerprint) and r.near_next == float(r.fingerprint == by[e].fingerprint)
    prints = defaultdict(set)
    for d, t, *_ in ROWS:
        prints[t or ""].add(by[d].fingerprint)
    assert all(len(v) == 1 for v in prints.values())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = db.sql(ORACLE_SQL[name])
    df, got = result(spark, sf, name)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    key = lambda some: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in some), key=repr)
    assert key(tuple(r[n] for n in names) for r in got) == key(want.select(", ".join(names)).fetchall())
