import numpy as np
from gatewatch.llm.sharding import external_shuffle, fisher_yates, shard, write_shards


def test_fisher_yates_is_a_uniform_permutation():
    assert fisher_yates(0, 1).tolist() == [] and fisher_yates(1, 1).tolist() == [0]
    counts = np.zeros((4, 4))
    for s in range(4000):
        p = fisher_yates(4, s)
        assert sorted(p) == [0, 1, 2, 3]
        counts[np.arange(4), p] += 1
    assert abs(counts / 4000 - 0.25).max() < 0.04


def test_shards_differ_by_one_row_and_reruns_agree(spark, tmp_path):
    rows = [(k, "same" if k % 3 else f"t{k}", 1) for k in range(503)] + [(None, "x", 2), (None, None, 3), (7, "same", 1), (7, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard(docs, 24, seed=3, bucket_bytes=600).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shard(docs.repartition(7), 24, seed=3, bucket_bytes=600).collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in rs)
    assert key(got) == key(again) and key(got) != key(shard(docs, 24, seed=4).collect())
    places = {r.doc_id: r.position for r in external_shuffle(docs.where("doc_id > 7")).collect()}
    assert abs(np.corrcoef(list(places), list(places.values()))[0, 1]) < 0.15
    write_shards(docs, str(tmp_path / "out"), 24)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert shard(docs.limit(0), 24).count() == 0


def test_a_hot_id_is_split(spark):
    rows = [(7, "same", k) for k in range(900)] + [(None, "none", k) for k in range(400)] + [(k, "long " * 5_000, k) for k in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __bucket long").repartition(4)
    placed = external_shuffle(docs, bucket_bytes=4_000).collect()
    assert sorted(r.position for r in placed) == list(range(len(rows)))
    hot = sorted(r.position for r in placed if r.doc_id == 7)
    assert len(hot) == 900 and external_shuffle(docs, bucket_bytes=4_000).columns == ["doc_id", "text", "position"]
    got = shard(docs, 5, bucket_bytes=4_000).collect()
    sizes = [sum(r.shard == k for r in got) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k])) for k in range(5))


def test_a_crowded_table_has_one_order_whatever_its_partitions(spark):
    rows = [(7, "same", k % 60, {"a": k % 2, "b": 1}) for k in range(900)] + [(7, f"t{k % 50}", k, None) for k in range(300)] + [(None, "none", k % 3, None) for k in range(400)] + [(k, "long " * 500, k, None) for k in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int, tags map<string,int>")
    runs = [[(r.position, r.doc_id, r.text, r.more, str(sorted((r.tags or {}).items()))) for r in external_shuffle(d, seed=2, bucket_bytes=4_000).collect()] for d in (docs.repartition(4), docs.repartition(7, "more"), docs.coalesce(1))]
    assert sorted(runs[0], key=lambda x: x[0]) == sorted(runs[1], key=lambda x: x[0]) == sorted(runs[2], key=lambda x: x[0])
    assert sorted(map(str, (x[1:] for x in runs[0]))) == sorted(str((d, t, m, str(sorted((g or {}).items())))) for d, t, m, g in rows)
    assert [x[0] for x in sorted(runs[0], key=lambda x: x[0])] == list(range(len(rows)))
