import hashlib
import re
from collections import Counter, defaultdict

import pytest
from gatewatch.llm import mixing
from pyspark.sql import functions as F


def mixed_by_hand(rows, seed="mix"):
    """doc_id -> (taken, whole), for rows (doc_id, source, text)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in rows}
    by = defaultdict(list)
    for d, s, _ in rows:
        by[s].append(d)
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(size[d] for d in by[s]) for s in sources}
    everything, full = sum(total.values()), set()
    while True:
        left = everything - sum(3 * total[s] for s in full)
        w = sum(weight[s] for s in sources if s not in full)
        target = {s: 3.0 * total[s] if s in full else left * weight[s] / w for s in sources}
        over = {s for s in sources if s not in full and target[s] >= 3 * total[s]}
        if not over or len(full | over) == len(sources):
            break
        full |= over
    out = {}
    for s in sources:
        budget = int(target[s] + 1e-9)
        epochs = budget // total[s] if total[s] else 0
        left = budget - epochs * total[s]
        for d in sorted(by[s], key=lambda d: hashlib.md5(f"{seed}:{d}".encode()).hexdigest()):
            part = max(0, min(size[d], left))
            left -= part
            out[d] = (epochs * size[d] + part, epochs + (1 if 2 * part >= size[d] > 0 else 0))
    return out


ROWS = [(k, f"s{k % 4}" if k % 9 else None, "w " * (k * 7 % 23)) for k in range(120)] + [(200 + k, "tiny", "a b") for k in range(2)] + [(300, "empty", ""), (301, "empty", None)]


@pytest.mark.parametrize("rows", [ROWS, [(1, "a", "x y"), (2, "b", "")], [(1, None, None)]])
def test_against_a_loop(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("other"))
    got = {r.doc_id: r.taken for r in mixing.mix(docs, mixing.word_count(F.col("text"))).collect()}
    want = mixed_by_hand(rows)
    assert got == {d: taken for d, (taken, _) in want.items()}
    made = mixing.mixed(docs, mixing.word_count(F.col("text")))
    assert made.columns == docs.columns
    assert Counter(r.doc_id for r in made.collect()) == Counter({d: n for d, (_, n) in want.items() if n})


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LISTED", 3)
    rows = [(None, "a", "w " * (k % 5)) for k in range(40)] + [(5, "a", "x y")] * 10 + [(5, "a", "y x"), (6, None, "z " * 9), (None, None, None)] + [(7, "b", "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("__row", F.lit(1)).withColumn("copies", F.lit(2))
    got = mixing.mix(docs, mixing.word_count(F.col("text"))).collect()
    words = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, words(t)) for d, s, t in rows)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target) and all(0 <= r.taken <= 3 * r.size for r in mine)
    made = mixing.mixed(docs, mixing.word_count(F.col("text")))
    assert made.columns == docs.columns
    counts = Counter((r.doc_id, r.source, r.text) for r in made.collect())
    assert set(counts) <= set(rows)
    for s in ("a", "b", None):
        target = next(r.target for r in got if r.source == s)
        total = sum(words(t) * n for (_, x, t), n in counts.items() if x == s)
        assert abs(total - target) <= max(words(t) for _, x, t in rows if x == s) / 2 + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs, mixing.word_count(F.col("text"))).count() == 0
