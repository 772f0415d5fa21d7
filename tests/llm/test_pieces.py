import hashlib
import random
import string
import time

import pytest

from gatewatch.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")

ODD = [None, "", " ", "   ", "a", "  a  b ", "▁x", "\n\n", "a\tb\r\n c", "日本😀 한국", "\x00a", "<0x41><s>", "aaaaaaa aaaa", "é é ﬁ", "x" * 3000, "ab" * 2000, " " * 70, "naïve word", "a    b     c" * 9, "\U0010ffff퟿"]


def test_like_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoder = pieces.Encoder(pieces.default_model(), pool_words=50)
    for k in range(3):
        flat, counts = encoder.encode([t or "" for t in ODD])
        at = 0
        for t, n in zip(ODD, counts.tolist(), strict=True):
            assert flat[at : at + n].tolist() == lib.encode(t or ""), repr(t)[:50]
            at += n
    assert pieces.decode_ids(encoder.model, flat, counts) == [lib.decode(lib.encode(t or "")) for t in ODD]
    lists = [[300, 3 + 0xE3, 400], [3 + 0xFF, 3 + 0x80], [0, 1, 5000], []]
    import numpy as np

    got = pieces.decode_ids(encoder.model, np.array(sum(lists, []), dtype=np.int32), np.array([len(x) for x in lists]))
    assert got == [lib.decode(x) for x in lists]


def test_long_unbroken_words():
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoder = pieces.Encoder(pieces.default_model())
    rng = random.Random(0)
    parts = "the quick internationalization representation ing tion ation ofthe andthe springframework s es ed er".split()
    kinds = [
        lambda n: "".join(rng.choices(string.ascii_lowercase, k=n)),
        lambda n: "".join(rng.choices(parts, k=n // 5 + 14)),
        lambda n: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 9))) * n,
        lambda n: "".join(rng.choices(parts, k=rng.randint(1, 3))) * (n // 3),
        lambda n: "".join(rng.choices("etainos", k=n)),
        lambda n: "".join(rng.choices("0123456789abcdef", k=n)),
        lambda n: "".join(rng.choices(string.printable.strip() + "é日", k=n)),
        lambda n: " " * rng.randint(1, 90) + "".join(rng.choice("-=*#/. ") * rng.randint(1, 70) for _ in range(5)),
    ]
    texts = [kind(rng.randint(65, 400)) for kind in kinds for _ in range(25)]
    texts += [(string.ascii_lowercase * 16_000)[:400_000], "".join(rng.choices("0123456789abcdef", k=400_000)), "ing" * 50_000]
    begin = time.perf_counter()
    flat, counts = encoder.encode(texts)
    assert time.perf_counter() - begin < 30
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert flat[at : at + n].tolist() == lib.encode(t), t[:50]
        at += n


def _field(number: int, value) -> bytes:
    def varint(x: int) -> bytes:
        return bytes([x & 127 | (128 if x > 127 else 0)]) + (varint(x >> 7) if x > 127 else b"")

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize(("piece", "kind"), [("own", 4), ("a\nb", 1), ("a▁b", 1)])
def test_models_that_need_more_are_refused(tmp_path, piece, kind):
    path = tmp_path / "m.model"
    path.write_bytes(_field(1, _field(1, piece.encode()) + _field(3, kind)) + _field(2, _field(3, 2)) + _field(3, _field(3, 1) + _field(4, 0)))
    with pytest.raises(ValueError, match="pieces|piece spans"):
        pieces.PieceModel(str(path))


def test_operator_on_frames(spark):
    rows = [(k, t, "kept") for k, t in enumerate(ODD)] + [(1, "", "kept"), (None, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = pieces.decode(pieces.encode(docs, pieces.default_model()), pieces.default_model())
    got = sorted(((r.doc_id, r.text, list(r.ids), r.decoded) for r in out.collect()), key=repr)
    assert got == sorted(((d, t, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for d, t, _ in rows), key=repr)
    assert pieces.encode(docs.limit(0), pieces.default_model()).count() == 0


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The  cat\nsat."), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: r for r in pieces.op10_sentencepiece(spark, str(tmp_path)).collect()}
    ids = lib.encode("The  cat\nsat.")
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha("The  cat\nsat."))
    assert (got[2].n_tokens, got[2].ids_sha256) == (0, sha(""))
