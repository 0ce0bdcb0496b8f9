import numpy as np

from tidemark.llm import sharding


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_hash_against_brute_force():
    keys = np.concatenate([np.arange(-50, 3000), np.array([2**63 - 1, -(2**63)])]).astype(np.int64)
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [jump(int(k), shards) for k in keys]


def test_law_and_slots(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(df, "doc_id", 24, buckets=8).collect()
    assert all(x["grown_shard"] in (x["shard"], 24) for x in rows)
    by = {}
    for x in rows:
        by.setdefault(x["shard"], []).append(x["slot"])
    assert set(by) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.assign_shards(odd_docs, "doc_id").collect()
    assert len(rows) == odd_docs.count()
    assert len({(x["shard"], x["slot"]) for x in rows}) == len(rows)
    assert [x["shard"] for x in rows if x["doc_id"] is None] == [jump(0, 24)]
    assert sharding.assign_shards(no_docs, "doc_id").collect() == []
