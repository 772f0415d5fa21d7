"""Alignment against a token-by-token version with the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from gatewatch.llm import alignment
from test_packing import odd_texts
from tokenizers import Tokenizer

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(texts):
    """For each text: the two sides' counts, groups, links, best links and sum of counts, by plain loops."""
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found, count = [], Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        a = library.encode(" " + t, add_special_tokens=False)
        raw = (" " + t).encode()
        back = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
        for k, b in enumerate(b for b in range(256) if b not in back.values()):
            back[chr(256 + k)] = b
        left = [(i, bytes(back[c] for c in library.id_to_token(i))) for i in a.ids]
        right = []
        for i in pieces.encode(t):
            p = pieces.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            found.append(None)
            continue
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s < end) for side in spans))
            start = end
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        count.update(links)
        found.append((len(left), len(right), groups, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(4)
    words = ["tea", "Coffee,", "unbelievable", "don't", "été", "x1", "straße", "naïve", "日本語", "über"]
    return [*odd_texts(150, seed=9), *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)), None, "", "tea", "tea", "has ▁ in it", "<|endoftext|> <s>", "a" * 900]


def columns(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum)


def test_query_against_plain_loops(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "LOT_LINKS", 300)
    some = texts()
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (*columns(r), r.groups_sha256) for r in alignment.op13_alignment(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(by_hand(some)))


def test_groups_rows_and_clashing_columns(spark):
    some = ["tea", "tea", None, "Coffee, été"]
    df = spark.createDataFrame([(None, t, "x", 7, 1) for t in some], "doc_id long, text string, n_a string, __lot int, number int")
    out = alignment.align(df, BYTES, PIECES)
    assert out.columns == ["doc_id", "__lot", "number", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = by_hand(some)
    got = out.collect()
    assert sorted(columns(r) for r in got) == sorted(w[:6] for w in want)
    assert {hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in got} == {w[6] for w in want}
    assert {(r["__lot"], r.number) for r in got} == {(7, 1)}
    assert alignment.align(df.limit(0), BYTES, PIECES).collect() == []
    assert [columns(r) for r in alignment.align(df.where("text is null"), BYTES, PIECES).collect()] == [(0,) * 6]


def test_terminals_and_links():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 3, 6, 7, 9])
    of_a, of_b = alignment.terminals(a, b)
    assert of_a.tolist() == [2, 2, 2, 4] and of_b.tolist() == [2, 2, 2, 4, 4]
    assert list(zip(*(x.tolist() for x in alignment.linked(a, b)))) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (3, 3), (3, 4)]
