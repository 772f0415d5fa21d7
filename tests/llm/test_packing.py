"""Packing against the library's ids, and the subset-sum pass against all choices."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from gatewatch.llm import packing
from gatewatch.llm.token_pool import TokenPool
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "é", "ß", "İ", "Σ", "'s", "'T", "1", "23", "!", "...", "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "‍", "ﬁ", "µ", "×", "\r\n", "▁", "\x00", "²", "ſ", "the", " of", " and the"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(("file", "kind", "plain"), [("word_bpe_49k.json", "lower", False), ("byte_bpe_50k.json", "bytes", True)])
def test_ids_are_the_librarys(file, kind, plain):
    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    pool = TokenPool(path, kind, plain, pool_words=2_000)
    texts = odd_texts(6_000)
    for k in range(0, len(texts), 1_000):
        some = texts[k : k + 1_000]
        flat, counts = pool.encode(pa.array(some, pa.string()))
        want = [e.ids for e in library.encode_batch([(" " if kind == "bytes" else "") + t for t in some], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]


def test_fullest_is_the_best_choice():
    rng = random.Random(3)
    for _ in range(300):
        room = rng.randint(1, 40)
        lengths = sorted(rng.sample(range(1, room + 1), min(room, rng.randint(1, 4))), reverse=True)
        counts = [rng.randint(1, 5) for _ in lengths]
        used = packing.fullest(lengths, counts, room)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(c, lengths))) <= room)
        assert sum(a * b for a, b in zip(used, lengths)) == best and all(0 <= u <= c for u, c in zip(used, counts))
    assert packing.fullest([], [], 7) == []


def test_a_window_takes_the_longest_piece_and_cuts_only_for_slack():
    packer = packing.Packer(10, pool_windows=1)
    windows = [w for k, n in enumerate([6, 3, 4, 7]) for w in packer.add(k, np.arange(n, dtype=np.int32))]
    windows += packer.finish()
    assert [[(d, s, len(i)) for d, s, i in w] for w in windows] == [[(0, 0, 6), (2, 0, 4)], [(3, 0, 7), (1, 0, 3)]]
    packer = packing.Packer(10, pool_windows=1)
    windows = [w for k in range(3) for w in packer.add(k, np.arange(7, dtype=np.int32))] + list(packer.finish())
    assert [[(d, s, len(i)) for d, s, i in w] for w in windows] == [[(0, 0, 7), (1, 0, 3)], [(2, 0, 7), (1, 3, 3)], [(1, 6, 1)]]


def check(docs, got, end_id, capacity):
    """``docs``: (id, text); ``got``: rows. Each id lies in one piece, sequences are gapless and full or a power of two."""
    library = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        want[d, len(ids), ids.tobytes()] += 1
    ids_of = {(d, n): raw for d, n, raw in want}
    pieces = defaultdict(list)
    for r in got:
        raw = ids_of[r.doc_id, r.doc_tokens]
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for (d, n, raw), copies in want.items():
        covered = np.zeros(n, dtype=int)
        for start, length in pieces.pop((d, n)):
            covered[start : start + length] += 1
        assert (covered == copies).all()
    assert not pieces
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return by


def rows():
    rng = random.Random(8)
    words = ["tea", "Coffee,", "unbelievable", "don't", "été", "x1"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 400])))) for k in range(150)]
    return [*docs, (None, None), (900, None), (900, None), (901, ""), (902, " \n"), (903, "tea " * 9_000), (904, "日" * 3_000), (5, "again")]


def test_every_id_lies_in_one_piece(spark):
    docs = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, start string, ids int").repartition(3)
    out = packing.pack(df, PATH, end_id=2, capacity=512)
    got = out.collect()
    by = check(docs, got, 2, 512)
    short = [parts for parts in by.values() if sum(n for _, n in parts) < 512]
    assert len(short) <= 3 * 9
    whole = packing.sequences(out).collect()
    assert sorted(len(r.ids) for r in whole) == sorted(sum(n for _, n in parts) for parts in by.values())
    spelled = {(r.sequence_id, r.offset): r.ids for r in got}
    assert all(r.ids[r2[1] : r2[1] + len(ids)] == ids for r in whole for r2, ids in spelled.items() if r2[0] == r.sequence_id)


def test_reruns_agree_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    first, second = (sorted(map(tuple, packing.op11_packing(spark, str(tmp_path)).collect()), key=str) for _ in range(2))
    assert first == second
    assert packing.pack(df.limit(0), PATH, end_id=2).collect() == []
