import random
from zlib import crc32

import numpy as np
import pytest
from gatewatch.llm import language, quality, samples, toxicity
from pyspark.sql import functions as F

SYLLABLES = {"aa": "ka lo mi ne ru ta", "bb": "sch ung ber lich tz ei", "cc": "ció ñas que dos bra el"}


def prose(rng, lang="aa", n=60):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(n))


def test_quality_on_held_out_texts(spark):
    rng = random.Random(1)

    def junk():
        t = prose(rng)
        return rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join([t.split()[0]] * 50)])

    texts = [(prose(rng), 1) if k % 4 else (junk(), 0) for k in range(400)]
    model = quality.fit(texts[:300])
    docs = spark.createDataFrame([(k, t, "s") for k, (t, _) in enumerate(texts[300:])] + [(900, None, ""), (901, "", ""), (902, "word " * 60_000, "")], "doc_id long, text string, score string")
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((rows[k] >= 0.3) == bool(y) for k, (_, y) in enumerate(texts[300:]))
    assert rows[900] == rows[901] and 0 <= rows[902] <= 1
    assert {round(quality.fit([("a", 1)] * 3).score(np.array([], dtype=int)), 6)} == {0.8} and 0 < quality.fit([]).score(np.array([1])) < 1


def test_hinge_model_separates():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 6, replace=False)) + (0 if k % 2 else 45) for k in range(80)]
    y = np.arange(80) % 2
    w, b = quality.dual_coordinate_descent(rows, [np.ones(6)] * 80, y, np.full(80, 10.0), 100)
    assert all(((w[x].sum() + b) > 0) == bool(v) for x, v in zip(rows, y, strict=True))


def test_language_filter(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, lang), lang if k % 11 else None) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.learn(docs, samples.fold(docs["doc_id"], 3) != 1)
    assert model.languages == ["aa", "bb", "cc"]
    more = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(500, None, 0.0), (501, "12 34 !", 0.0), (502, "", 0.0), (503, prose(rng, "bb", 90_000), 0.0)], "doc_id long, text string, score double"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(more, model).collect()}
    truth = {k: lang for k, lang in enumerate(["aa", "bb", "cc"] * 60)}
    assert all(got[k][0] == v and 0 <= got[k][1] <= 1 for k, v in truth.items())
    assert [got[k][0] for k in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    grams = np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64)
    two = language.LanguageFilter({"x": grams[:3000], "y": grams[2000:]})
    mask = two.containing(grams)
    assert (mask[:3000] & np.uint64(1)).all() and (mask[2000:] & np.uint64(2)).all()
    assert ((mask[:2000] & np.uint64(2)) > 0).mean() < 3 * two.false_rate[1] + 0.01
    assert language.learn(docs.limit(0), docs["doc_id"] >= 0).languages == []


def test_network_gradient():
    """Against finite differences, in every parameter and input."""
    rng = np.random.default_rng(3)
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = (net.p[k] + rng.standard_normal(net.p[k].shape) * 0.3).astype(np.float64)
    px = rng.standard_normal((5, 3, 2, 3 * toxicity.HIDDEN))
    real = np.ones((3, 5), dtype=bool)
    real[1, 3:] = False
    y = np.array([1.0, 0.0, 1.0])
    _, g, dpx = net.gradient(px, real, y)
    eps = 1e-3

    def loss():
        z = net.forward(px.astype(np.float64), real)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name, p in [*net.p.items(), ("px", px)]:
        grad = dpx if name == "px" else g[name]
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 12)]:
            old = p[at]
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - grad[at]) < 2e-3, (name, at)


@pytest.fixture(scope="module")
def toxic_corpus():
    rng = random.Random(5)
    out = []
    for k in range(700):
        words = prose(rng, rng.choice(["aa", "bb"]), rng.randint(5, 250)).split()
        if k % 3 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["zwurk", "gloppig", "xax" + rng.choice("aeiou") * 2]))
        out.append((" ".join(words), int(k % 3 == 0)))
    return out


def test_toxicity_on_held_out_texts(spark, toxic_corpus):
    net = toxicity.fit(toxic_corpus[:500], {0: 0.67, 1: 0.33})
    docs = spark.createDataFrame([(k, t, 1) for k, (t, _) in enumerate(toxic_corpus[500:])] + [(900, None, 1), (901, "", 1), (902, "ka lo mi " * 20_000 + "zwurk gloppig", 1)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    right = [(got[k] >= 0.5) == bool(y) for k, (_, y) in enumerate(toxic_corpus[500:])]
    assert np.mean(right) > 0.95
    assert got[900] == got[901] < 0.5 and got[902] > 0.5
    assert toxicity.fit([("a", 0)] * 8).slope == 0


def test_windows_cover_every_word():
    for n in [0, 1, 31, 32, 33, 48, 49, 64, 1000]:
        seen = set()
        for s in toxicity.windows_of(n):
            seen |= set(range(s, min(n, s + toxicity.WINDOW)))
        assert seen == set(range(n))


def test_samples_are_bounded_and_skip_nulls(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(50)] + [(60, None), (None, "x"), (61, "y" * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(60, 1), (61, 1), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    learn = samples.fold(labels["doc_id"], 5) != 0
    got = samples.labelled_texts(docs, labels, "quality", learn, 10)
    assert 18 <= len(got) <= 20 and sum(y for _, y in got) >= 8
    whole = samples.labelled_texts(docs, labels, "quality", learn, 100)
    assert len(whole) == sum(k % 2 >= 0 for k in range(50) if crc32(str(k).encode()) % 5) + (crc32(b"61") % 5 > 0)
    assert any(len(t) == 30_000 for t, _ in whole)
    few = samples.labelled_texts(docs, labels, "quality", learn, 100, bytes_per_class=20)
    assert set(few) <= set(whole) and len(few) < len(whole) and all(0 < sum(len(t) for t, y in few[:-1] if y == k) < 30_000 + 25 for k in (0, 1))
    assert samples.best_cut([0.0, 1.0, 2.0, 3.0], [0, 0, 1, 1]) == 1.5
    a, b = samples.platt([-2, -1, 1, 2] * 20, [0, 0, 1, 1] * 20)
    assert a > 0 and abs(b) < 0.5


def test_unspaced_texts_are_read_whole(spark, toxic_corpus):
    rng = random.Random(9)
    for n in (40, 41, 42, 47, 1_001):
        run = "".join(chr(0x4E00 + k) for k in range(n))
        found, read = list(toxicity.pieces(run)), set()
        assert max(map(len, found)) <= toxicity.LETTERS
        for p in found:
            read |= set(p)
        assert read == set(run)
    net = toxicity.fit([("".join(t.split()) if k % 2 else t, y) for k, (t, y) in enumerate(toxic_corpus[:500])], {0: 0.67, 1: 0.33})
    calm = ["".join(prose(rng, lang, 3_000).split())[:10_000] for lang in ("aa", "bb") for _ in range(5)]
    toxic = [t[:5_000] + "zwurkgloppigxaxaa" + t[5_000:] for t in calm]
    joined = [j.join([*prose(rng, "aa", 800).split(), "gloppig", *prose(rng, "aa", 800).split()]) for j in "-_/"]
    docs = spark.createDataFrame(list(enumerate(calm + toxic + joined)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert all(got[k] < 0.5 for k in range(10)) and all(got[k] > 0.5 for k in range(10, 23))


def test_windows_of_long_texts_are_those_of_short_ones(monkeypatch):
    rng = random.Random(3)
    scorer = toxicity.Scorer(toxicity.Network(4))
    words = ["".join(rng.choices("abcde-_", k=rng.choice([1, 3, 5, 50, 90]))) for _ in range(3_000)]
    text = " ".join(words)
    assert list(toxicity.split_long(text)) == toxicity.split(text)
    monkeypatch.setattr(toxicity, "LONG_CHARS", 1_000)
    assert list(toxicity.split_long(text)) == toxicity.split(text)
    for n in [*range(70), 500, 2_000]:
        want = scorer._short([words[:n]])[0]
        for block in (1, 3, 1_024):
            monkeypatch.setattr(toxicity, "BLOCK", block)
            assert abs(scorer._long(iter(words[:n])) - want) < 1e-5


def test_a_word_that_repeats_is_read_each_time():
    assert toxicity.split("a a  A b") == ["a", "a", "a", "b"]
    joiners = "-" * 100
    assert "".join(toxicity.split(joiners)) == joiners


@pytest.mark.parametrize("piece", [5, 64, 1_000])
def test_votes_do_not_depend_on_the_blocks(monkeypatch, piece):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdeéßΣ ñ,.日 \n", k=4_000))
    grams = lambda: sorted(x for points, old in language._blocks(text) for code in language._grams(points, old) for x in code.tolist())
    want = grams()
    model = language.LanguageFilter({"x": np.unique(np.array(want, np.uint64)[::3]), "y": np.unique(np.array(want, np.uint64)[::5])})
    votes = model.votes(text)
    monkeypatch.setattr(language, "_PIECE", piece)
    assert grams() == want and (model.votes(text) == votes).all()


def test_empty_tables_and_equal_votes(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language.identify(docs, language.learn(docs, docs["doc_id"] >= 0)).count() == 0
    assert quality.score(docs, quality.fit_on(docs, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit_on(docs, labels)).count() == 0
    both = language.LanguageFilter({"b": np.array([1], np.uint64), "a": np.array([1], np.uint64)})
    assert both.predict("some letters") == ("a", 0.0)


def test_rare_languages_are_learned(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, "aa", 20), "aa") for k in range(3_000)] + [(5_000 + k, prose(rng, "bb", 20), "bb") for k in range(3)] + [(6_000, prose(rng, "cc", 200), "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, docs["doc_id"] >= 0, sample_rows=100)
    assert model.languages == ["aa", "bb", "cc"]
    assert [model.predict(prose(rng, lang, 50))[0] for lang in ("aa", "bb", "cc")] == ["aa", "bb", "cc"]


def test_more_languages_than_a_word_has_bits(spark):
    letters = np.random.default_rng(8).permutation(np.arange(0x4E00, 0x9000))
    own = {f"l{k:03}": [chr(c) for c in letters[20 * k : 20 * k + 20]] for k in range(150)}
    rng = random.Random(8)
    text = lambda lang: " ".join("".join(rng.choices(own[lang], k=4)) for _ in range(30))
    docs = spark.createDataFrame([(10 * k + j, text(lang), lang) for k, lang in enumerate(own) for j in range(3)], "doc_id long, text string, lang string")
    model = language.learn(docs, docs["doc_id"] >= 0)
    assert model.languages == sorted(own)
    asked = spark.createDataFrame([(k, text(lang)) for k, lang in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()}
    assert got == dict(enumerate(own))


def test_bounds_of_fitting_are_parameters(spark, toxic_corpus):
    docs = spark.createDataFrame([(k, f"{w} common words here {k}", lang) for k, (w, lang) in enumerate([("unus", "aa"), ("zwei", "bb")] * 30)], "doc_id long, text string, lang string")
    every = language.learn(docs, F.lit(True), least_share=0.0, few_rows=None, most_grams=None)
    bounded = language.learn(docs, F.lit(True), most_grams=3)
    for r in docs.collect():
        grams = language._distinct_grams(r.text)
        holds = lambda model, r=r, grams=grams: int(np.count_nonzero(model.containing(grams) & np.uint64(1 << model.languages.index(r.lang))))
        assert holds(every) == len(grams) and holds(bounded) < len(grams)
    net = toxicity.fit(toxic_corpus[:300], {0: 0.67, 1: 0.33}, fit_windows=None)
    right = [(s > 0.5) == y for s, (_, y) in zip(toxicity.Scorer(net).scores([t for t, _ in toxic_corpus[300:500]]), toxic_corpus[300:500])]
    assert np.mean(right) > 0.85
