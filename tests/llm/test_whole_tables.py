"""Queries that SQL can't express, over a whole table, against brute force."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.llm.test_neardup import brute_classes
from tests.llm.test_sharding import jump
from tests.llm.test_substrings import brute
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, texts):
    raw = [t.encode() for t in texts.values()]
    got = {x["doc_id"]: x for x in QUERIES["op1_suffix_array"](spark, SF).collect()}
    assert len(got) == len(texts)
    for d, t, gone in zip(texts, raw, brute(raw, 200), strict=True):
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        kept = hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(t), sum(gone), runs, kept)


def test_op6(spark, texts):
    got = {x["doc_id"]: x["class_id"] for x in QUERIES["op6_near_duplicates"](spark, SF).collect()}
    assert got == brute_classes(texts)


def test_op7(spark, texts):
    rows = QUERIES["op7_sharding"](spark, SF).collect()
    slots = defaultdict(list)
    for x in rows:
        raw = texts[x["doc_id"]].encode()
        assert (x["size"], x["text_crc32"], x["law"], x["shard"], x["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "key", jump(x["doc_id"], 24), jump(x["doc_id"], 25))
        slots[x["shard"]].append(x["slot"])
    assert len(rows) == len(texts) and all(sorted(v) == list(range(len(v))) for v in slots.values())
