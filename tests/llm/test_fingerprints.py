import hashlib
import re
import unicodedata

import pytest

from gatewatch.llm import fingerprints as fp

TEXTS = ["Straße  AM\tMeer", "STRASSE am meer ", "été", "ÉTÉ", "ﬁn e", "fin e", "", None, "a\nb", "a b", "x" * 5000, "　a b　", "日本", "other", "é"]


def form(text):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    t = nfkc(nfkc(text or "").casefold())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")


@pytest.mark.parametrize("bits", [64, 2])
def test_equal_forms_and_no_others(spark, bits):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("doc_id", "fingerprint_of")
    got = {r.fingerprint_of: r.fingerprint for r in fp.fingerprints(docs, bits=bits).collect()}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (form(TEXTS[a]) == form(TEXTS[b])), (TEXTS[a], TEXTS[b])


@pytest.mark.parametrize("bits", [64, 1])
@pytest.mark.parametrize("repeat", [False, True])
def test_edit_stability(spark, bits, repeat):
    rows = [(3 * k, t) for k, t in enumerate(TEXTS)] + ([(6, TEXTS[2]), (6, "two"), (None, "no id"), (9, TEXTS[3])] if repeat else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.edit_stability(docs, bits=bits).collect()
    assert len(got) == len(rows)
    if repeat:
        return
    ordered = sorted(rows)
    by_id = {r.doc_id: r for r in got}
    own = {d: form(t) for d, t in rows}
    for (d, t), (e, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u, r = t or "", u or "", by_id[d]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(form(edited) == own[d]) and r.near_next == float(own[e] == own[d])
        assert (r.fingerprint == by_id[e].fingerprint) == (own[e] == own[d])


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert fp.edit_stability(docs.limit(0)).count() == 0
    (r,) = fp.edit_stability(docs).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"aa").hexdigest()
    assert fp.fingerprints(docs.limit(0)).count() == 0


def test_clashing_columns_pass(spark):
    rows = [(1, "Tea", "mine", "form", 7), (2, "tea ", "x", "y", 8), (3, "cup", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __d string, __d_form string, __ordinal int")
    for bits in (64, 1):
        out = fp.fingerprints(docs, bits=bits)
        assert out.columns == [*docs.columns, "fingerprint"]
        got = sorted(out.collect())
        assert [tuple(r)[:5] for r in got] == rows
        assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint
