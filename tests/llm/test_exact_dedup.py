import random

import pyarrow as pa

from gatewatch.llm.exact_dedup import _PARTIAL, CuckooIndex, _grouped, _read, deduplicated, exact_dedup


def test_index_inserts_finds_deletes_and_grows():
    rng = random.Random(5)
    index, live = CuckooIndex(4, slots=2), {}
    for k in range(6000):
        key = rng.randrange(3000).to_bytes(8, "little") * 2
        if rng.random() < 0.3:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            index.insert(key, k)
            live[key] = k
    assert index.resizes > 3 and index.live == live
    for k in range(3000):
        key = k.to_bytes(8, "little") * 2
        assert index.find(key) == live.get(key)


def test_keeps_the_longest_then_smallest(spark):
    rows = [(4, "a b"), (2, "ab"), (3, "a  b"), (1, "a  b"), (9, None), (8, ""), (7, " \n"), (None, "q"), (6, "q"), (5, "é\x0bx" * 4000), (5, "é\x0bx" * 4000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, keep_id string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()), key=repr)
    assert got == sorted([(4, 1, 4, False), (2, 1, 4, False), (3, 1, 4, False), (1, 1, 4, True), (9, 7, 3, False), (8, 7, 3, False), (7, 7, 3, True), (None, 6, 2, False), (6, 6, 2, True), (5, 5, 2, True), (5, 5, 2, True)], key=repr)
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7]
    apart = spark.createDataFrame([(None, "one"), (None, "two"), (3, "x"), (3, "y"), (3, "y ")], "doc_id long, text string")
    assert sorted(r.text for r in deduplicated(apart).collect()) == ["one", "two", "x", "y "]
    assert exact_dedup(docs.limit(0)).count() == 0 and deduplicated(docs.limit(0)).count() == 0


def test_a_reading_task_hands_its_index_on():
    columns = [[k.to_bytes(8, "little") for k in (1, 2, 1, 3, 1)], [5, 1, 9, 1, 2], [10, 20, 30, 40, 50], [1] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTIAL, strict=True)], schema=_PARTIAL)
    for most in (1, 100):
        partial = [r for b in _read(iter([batch, batch]), most) for r in b.to_pylist()]
        assert len(partial) == (6 if most == 1 else 3)
        again = pa.RecordBatch.from_pylist(partial, schema=_PARTIAL)
        whole = sorted((r["digest"][0], r["n_points"], r["keep_id"], r["group_size"]) for b in _grouped(iter([again])) for r in b.to_pylist())
        assert whole == [(1, 9, 30, 6), (2, 1, 20, 2), (3, 1, 40, 2)]
