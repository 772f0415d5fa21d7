from collections import Counter

import corpus_pipeline as cp
import pytest
from gatewatch.llm import quality
from gatewatch.llm.samples import fold
from test_jaccard_join import brute
from test_mixing import mixed_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.cache())
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
        if k < 4:
            assert docs.columns == out[0].columns
    return [d.collect() for d in out]


def test_stages(spark, stages):
    docs, good, exact, near, mixed, tokens = stages
    model = quality.fit_on(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    grams = quality.Grams()
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in docs if model.score(grams.of(r.text or "")) >= cp.LEAST_QUALITY)
    best = {}
    for r in good:
        key = "".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(d for _, d in best.values())
    classes = brute([(r.doc_id, r.text) for r in exact], 5, 80)
    assert sorted(r.doc_id for r in near) == [d for d, _, c in classes if d == c]
    want = mixed_by_hand([(r.doc_id, r.source, r.text) for r in near])
    assert Counter(r.doc_id for r in mixed) == Counter({d: w[1] for d, w in want.items() if w[1]})
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed)
    assert all(r.round_trip for r in tokens)


ODD = (
    [(None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu", "a")] * 3
    + [(None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu", "a"), (None, "all of its own one two three", "b"), (None, None, "b")]
    + [(7, "one two three four five six seven eight nine ten eleven twelve", None), (7, "one two three four five six seven eight nine ten eleven twelve more", None)]
    + [(9, "", "a"), (9, "", "a"), (10, "very long " * 40_000, "a"), (11, "very  long " * 40_000, "a")]
)


def test_stages_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(d, t, None, s, len(t or ""), "x") for d, t, s in ODD], "doc_id long, text string, lang string, source string, n_chars long, __row string")
    rows = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)
    exact = cp.drop_copies(spark, docs, SF)
    assert exact.columns == docs.columns
    assert rows(exact) == sorted(set(ODD) - {(10, "very long " * 40_000, "a"), (None, None, "b")}, key=repr)
    near = cp.drop_near_copies(spark, docs, SF)
    assert near.columns == docs.columns
    found = rows(near)
    # one of each component, and all rows without a word
    assert len(found) == 7 and found.count((9, "", "a")) == 2 and (10, "very long " * 40_000, "a") in found and (None, None, "b") in found
    assert sum("alpha" in (t or "") for _, t, _ in found) == 1 and sum(d == 7 for d, _, _ in found) == 1
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(ODD)
    words = {s: sum(len((t or "").split()) for _, t, x in ODD if x == s) for s in ("a", "b", None)}
    got = {s: sum(len((t or "").split()) for _, t, x in rows(mixed) if x == s) for s in words}
    assert all(got[s] <= 3 * words[s] + 1 for s in words) and got[None] == 3 * words[None] and got["b"] == 3 * words["b"]
    tokens = cp.tokenize(spark, docs, SF).collect()
    assert len(tokens) == len(ODD) and all(r.round_trip for r in tokens)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_gives_the_same(spark, stages):
    got = cp.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, r.n_tokens) for r in stages[-1])
