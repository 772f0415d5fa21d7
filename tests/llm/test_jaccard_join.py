import random
import re
from collections import Counter

import numpy as np
import pytest

from gatewatch.llm import jaccard_join as jj
from gatewatch.llm.components import components


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 5)))
    rows, texts = [], ["", None, "one", "One", "two words", " two\twords\x0b ", "a a a a a a", "x" * 300, "Ä b c d"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy).title())
    hot = [word() for _ in range(80)]
    for _ in range(40):
        copy = list(hot)
        copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
    for _ in range(15):
        texts.append(" ".join(hot[:30] + [word() for _ in range(rng.randint(0, 12))]))
    rng.shuffle(texts)
    for k, t in enumerate(texts):
        rows.append((7 * k % 1009, t))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 2, 80)])
def test_against_all_pairs(spark, seed, k, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jj.jaccard_join(docs, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_shingles_of_all_texts_fill_no_bucket(spark, monkeypatch):
    """With small flushes, so that most shared shingles go as numbers."""
    monkeypatch.setattr(jj, "PACK", 400)
    monkeypatch.setattr(jj, "OFTEN", 3)
    rows = corpus(5) + [(5_000 + k, f"all of these begin alike but end w{k} x{k} y{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jj.jaccard_join(docs, 3, 80).collect())
    assert got == brute(rows, 3, 80)
    texts = [f"one two three four five six s{k} t{k} u{k}" for k in range(4_000)]
    flat, counts = jj.shingle_sets(texts, 4)
    owner = np.repeat(np.arange(len(texts)), counts)
    packed = [r for b in jj._flushed(7, np.arange(len(texts)), counts, owner, flat, 5) for r in b.to_pylist()]
    held = [r for r in packed if r["n"] == jj._HELD]
    in_buckets = sum(len(r["payload"]) for r in packed if r["n"] == jj._SETS)
    assert {r["bucket"] for r in held} == {7 % 5} and sum(len(jj._listed(r["payload"])[0]) for r in packed if r["n"] == jj._ASKED) == 3
    assert in_buckets < 4_000 * 3 * 8 + 4_000 * 5 * 16 + 100


def test_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d e", 1), (5, "a b c d e", 2), (None, "A B C D E", 3), (9, None, 4), (8, "", 5)], "doc_id long, text string, n long")
    got = sorted((tuple(r) for r in jj.jaccard_join(docs).collect()), key=repr)
    assert got == sorted([(5, 1, 5), (5, 1, 5), (None, 1, 5), (9, 0, 9), (8, 0, 8)], key=repr)
    assert jj.jaccard_join(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).read().collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("buckets", [4, 64, 200, 4_096])
@pytest.mark.parametrize("flushes", [1, 3])
def test_flushes_of_all_tasks_spread_over_the_buckets(buckets, flushes):
    homes = Counter(jj._home(task << 24 | k, buckets) for task in range(200) for k in range(flushes))
    assert max(homes.values()) <= max(2, 3 * 200 * flushes / buckets)
    alone = Counter(jj._home(k, buckets) for k in range(200))
    assert max(alone.values()) <= max(2, 3 * 200 / buckets)
