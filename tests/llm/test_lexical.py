import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tidemark.llm import lexical as x

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs: list[tuple], items: list[tuple], k: int = x.K) -> set:
    parsed = [(d, words(t)) for d, t in docs]
    parsed = [(d, w) for d, w in parsed if w]
    n, total = len(parsed), sum(len(w) for _, w in parsed)
    df = Counter(t for _, w in parsed for t in set(w))
    out = set()
    for item, text in set(items):
        scored = []
        for at, (d, w) in enumerate(parsed):
            tf, m = Counter(w), 75 + (25 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf)
            if s:
                scored.append((-s, d is None, d or 0, at))
        out |= {(item, r + 1, None if null else d, -s) for r, (s, null, d, _) in enumerate(sorted(scored)[:k])}
    return out


def found(spark, docs, items, **options) -> set:
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, item_id int").repartition(3)
    index = x.build_index(table, **options)
    return {tuple(r) for r in x.search(index, spark.createDataFrame([(*i, 5, "s") for i in items], "item_id long, text string, rank int, score string")).collect()}


@settings(deadline=None)
@given(st.lists(st.text("aB9é -\n🦄", max_size=12) | st.none(), max_size=8))
def test_terms(texts):
    hashes, of = x.terms_of(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert of.tolist() == [i for i, _ in want]
    assert len(set(zip(hashes.tolist(), [w for _, w in want], strict=True))) == len({w for _, w in want}) == len(set(hashes.tolist()))


def test_terms_of_long_texts_in_pieces(monkeypatch):
    texts = pa.array([prose(3, 3000), "z" * 5000 + " tail", None, prose(4, 50)])
    whole = x.terms_of(texts)
    monkeypatch.setattr(x, "PIECE_BYTES", 100)
    assert all((a == b).all() for a, b in zip(whole, x.terms_of(texts), strict=True))


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 20])
def test_against_brute_force(spark, shard_bytes):
    r = random.Random(shard_bytes)
    docs = [(i, prose(i % 60, r.randint(1, 60))) for i in range(150)] + [(i, "common words here") for i in range(500, 540)]
    docs += [(None, prose(3, 40)), (None, None), (7, ""), (7, prose(3, 40)), (7, prose(3, 40)), (900, "!!! --- \n"), (901, prose(5, 4000)), (-4, "ÉTÉ Été été 🦄🦄 x\x00y")]
    items = [(i, prose(i, 20)) for i in range(12)] + [(50, "common Words here HERE"), (51, None), (52, "..."), (53, "nowhere found"), (54, "Été x"), (55, prose(5, 800)), (50, "common Words here HERE"), (50, "pine")]
    assert found(spark, docs, items, shard_bytes=shard_bytes) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = [(i, prose(i % 9, 30)) for i in range(40)], [(i, prose(i % 5, 12)) for i in range(20)]
    monkeypatch.setattr(x, "BLOCK_TERMS", 40)
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    some = [(1, "a b"), (2, "c")]
    assert found(spark, [], some) == set() and found(spark, some, []) == set() and found(spark, [(1, None), (2, "--")], some) == set()


def test_levels_keep_falling_impacts():
    """Within each term's range at every level, impacts fall: what makes the first of a range a bound."""
    docs = [(i, prose(i % 30, 5 + i % 40)) for i in range(100)]
    hashes, of = x.terms_of(pa.array([t for _, t in docs]))
    shard = x.Shard(x._shard(np.arange(100), np.ones(100, bool), hashes, of, 100, len(hashes)))
    ranges = list(zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist(), strict=True))
    for level in range(shard.levels + 1):
        assert all((np.diff(shard.impacts[level, a:b]) <= 0).all() for a, b in ranges)
        if level < shard.levels:
            ones, zeros = shard.ones[level], int(shard.zeros[level])
            ranges = [y for a, b in ranges for y in ((a - ones[a], b - ones[b]), (zeros + ones[a], zeros + ones[b]))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    assert {tuple(r) for r in x.op12_lexical_search(spark, f"/root/testdata/{sf}").collect()} == set(con.execute(x.ORACLE["op12_lexical_search"]).fetchall())
