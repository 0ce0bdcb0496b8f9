import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400)
@given(st.text("abc", max_size=24), st.text("abc", max_size=24), st.integers(0, 26))
def test_banded_distance(a, b, most):
    assert min(neardup.banded_distance(list(a), list(b), most), most + 1) == min(distance(a, b), most + 1)


def edited(words, share, r):
    out = list(words)
    for i in r.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = "edit" + str(r.randint(0, 9999))
    return out


def brute_classes(texts: dict) -> dict:
    """The least id of each component of pairs that are similar; all pairs are compared."""
    words = {k: re.sub(r"[\W_]+", " ", t.lower()).split() for k, t in texts.items()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if neardup.similar(words[a], words[b]) and words[a]:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def test_planted_groups(spark):
    r = random.Random(8)
    texts, n = {}, 0
    for g in range(12):
        base = prose(g, r.randint(30, 120)).split()
        for k in range(1 + g):
            texts[n] = " ".join(base if k % 3 == 0 else edited(base, 0.02, r))
            n += 1
    for g in range(60):
        texts[n] = "A line that many documents share at their start. " + prose(500 + g, 40)
        n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x for x in neardup.near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert {k: x["class_id"] for k, x in got.items()} == want
    assert all(x["class_size"] == sum(v == x["class_id"] for v in want.values()) for x in got.values())
    kept = neardup.keep_one(df)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))


def test_a_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "_id long, leader long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "_id long")
    got = {x["_id"]: (x["class"], x["n_links"]) for x in neardup.components(nodes, edges).collect()}
    assert {v[0] for k, v in got.items() if k <= 40} == {0} and got[101] == (100, 1) and got[200] == (200, 0) and got[3][1] == 2


def test_order_matters():
    a = prose(3, 60)
    b = " ".join(reversed([" ".join(a.split()[i : i + 10]) for i in range(0, 60, 10)]))
    _, s = neardup.sketch_batch(pa.array([a, a, b, "", None, "one two"]), 5, 3, 64)
    assert (s[0] == s[1]).all() and not s[3].any() and not s[4].any() and s[5].any()
    assert (s[0] == s[2]).mean() < 0.35


def test_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append(x["class_id"])
    assert by[5] == [4] and by[4] == [4] and by[6] == [6, 6] and by[1] == [1] and by[8] == [-1] and by[2] == [2] and by[3] == [3]
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sorted(x["doc_id"] for x in rows) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 10]
    assert {x["text"] for x in rows if x["doc_id"] == 10} == {"123 456 !!!", "another text with the same id"}
    assert neardup.near_duplicates(no_docs).collect() == []


def test_copies_down_to_the_limit_are_found(spark):
    r = random.Random(21)
    texts, twins = {}, {}
    for share in (0.05, 0.1, 0.15, 0.2):
        for g in range(40):
            n = len(texts)
            base = prose(10_000 + n, 100).split()
            texts[n], texts[n + 1] = " ".join(base), " ".join(edited(base, share, r))
            twins.setdefault(share, []).append(n)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(df).collect()}
    found = {share: sum(got[n + 1] == n for n in ns) / len(ns) for share, ns in twins.items()}
    assert all(x >= 0.95 for x in found.values()), found


def test_every_group_of_a_bucket_is_compared(spark, monkeypatch):
    # all texts share every bucket, and only a comparison tells the groups apart
    def one_bucket(column, *options):
        counts, found = neardup.sketch_batch(column, *options)
        return counts, found * 0 + 7

    r = random.Random(4)
    texts = {}
    for g in range(9):
        base = prose(20_000 + g, 60).split()
        for k in range(3):
            texts[9 * k + g] = " ".join(base if k == 0 else edited(base, 0.05, r))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(neardup, "sketched", _in_driver(spark, one_bucket))
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(df).collect()}
    assert got == {n: n % 9 for n in texts}


def _in_driver(spark, profile):
    """sketched() by a function that workers needn't import."""
    def run(words, shingle, picked, sketches):
        rows = words.collect()
        counts, found = profile(pa.array([x["words"] for x in rows]), shingle, picked, sketches)
        out = [(int(v), x["_id"], int(c)) for x, c, f in zip(rows, counts, found, strict=True) for v in f]
        return spark.createDataFrame(out, "bucket long, _id long, n_words int")

    return run


def test_rare_grams_and_bits_never_lose_a_link():
    r = random.Random(5)
    common = np.random.default_rng(1).integers(0, 50, neardup.SLOTS)
    linked = 0
    for g in range(200):
        a = prose(30_000 + g, r.randint(2, 90) if g % 2 else r.randint(300, 520)).split()
        b = edited(a, r.choice([0.1, 0.2]), r) if g % 3 else a[r.randint(0, 3) :] + a[:2]
        if not neardup.similar(a, b) or a == b:
            continue
        linked += 1
        column = pa.array([" ".join(a), " ".join(b), ""])
        grams, doc, _ = neardup.rare_grams(column, common, 0.8)
        assert set(grams[doc == 0]) & set(grams[doc == 1]) and not (doc == 2).any()
        counts, bits = neardup.word_bits(column)
        assert counts.tolist() == [len(a), len(b), 0]
        odd = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in bits[0] ^ bits[1])
        assert (odd + abs(len(a) - len(b))) / 2 <= distance(a, b)
    assert linked > 100


def test_families_that_share_a_template(spark):
    # pairs of texts with most of their words from one template: each family is compared, and none is lost
    r = random.Random(9)
    template = prose(40_000, 70).split()
    texts = {}
    for g in range(60):
        own = prose(41_000 + g, 30).split()
        for k in range(2):
            texts[2 * g + k] = " ".join(template + (own if k == 0 else edited(own, 0.1, r)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(df).collect()} == brute_classes(texts)


def test_unlike_texts_are_not_all_paired(spark):
    """A passage that all texts share makes large buckets; few pairs are left to align."""
    passage = prose(50_000, 60)
    texts = [(i, f"{prose(51_000 + i, 60)} {passage} {prose(52_000 + i, 60)}") for i in range(300)]
    df = spark.createDataFrame(texts, "_id long, words string")
    one_bucket = df.select(F.lit(7).cast("long").alias("bucket"), "_id", F.col("_id").alias("class"), F.lit(False).alias("small"))
    left = neardup._may_be_alike(df, one_bucket, 0.8)
    assert left.count() < 300


def test_keep_one_keeps_each_class_once(spark):
    a, b = prose(60_000, 60), prose(60_001, 60)
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " more", "x"), (None, b, "y"), (None, b + " more", "y"), (3, None, "z"), (3, None, "z"), (4, a, "x"), (1, a, "x")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _id string"))
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, a), (1, b), (3, None), (3, None)], "doc_id long, text string").collect()))


@pytest.mark.parametrize("n", [5, 6, 8, 10, 20, 30, 37, 38, 46])
def test_links_between_short_texts_are_found(spark, n):
    """Texts of few words with as many edits as the link of 0.8 allows, every one of 60 pairs."""
    r = random.Random(n)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(60):
        a = [r.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for i in r.sample(range(n), n // 5):
            b[i] = r.choice(vocabulary)
        texts[2 * g], texts[2 * g + 1] = " ".join(a), " ".join(b)
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(60)) >= 59


def test_folded_bits_never_lose_a_link():
    r = random.Random(6)
    for g in range(120):
        a = prose(80_000 + g, r.randint(20, 400)).split()
        b = edited(a, 0.2, r)
        counts, *longs = neardup.signed(pa.array([" ".join(a), " ".join(b)]))
        odd = sum(bin((int(x[0].as_py()) ^ int(x[1].as_py())) & (1 << 64) - 1).count("1") for x in longs)
        assert counts.to_pylist() == [len(a), len(b)] and len(longs) == neardup.FOLDED
        assert odd <= 2 * distance(a, b)


def test_components_that_are_done_leave_the_rounds(spark, monkeypatch):
    """Stars are done in one round; only the chain goes on, and edges added later connect classes alone."""
    rows, written = {}, neardup.written

    def counted(df, label):
        out = written(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counted)
    stars = [(1000 * s, 1000 * s + k) for s in range(1, 21) for k in range(1, 11)]
    edges = spark.createDataFrame(stars + [(i, i + 1) for i in range(40)], "_id long, leader long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *sorted({x for e in stars for x in e}), 99_999]], "_id long")
    found = neardup.components(nodes, edges)
    got = {x["_id"]: (x["class"], x["n_links"]) for x in found.collect()}
    assert all(got[k][0] == 0 for k in range(41)) and all(got[b] == (a, 1) for a, b in stars) and got[99_999] == (99_999, 0)
    assert rows["omh-edges"][0] == 20 * 31 + 121 and rows["omh-edges"][1] == 121
    more = spark.createDataFrame([(1005, 2003), (2004, 1000), (7, 3000), (99_999, 4001)], "_id long, leader long")
    got = {x["_id"]: (x["class"], x["n_links"]) for x in neardup._merged(found, more).collect()}
    assert got[2000] == (1000, 10) and got[2003] == (1000, 2) and got[1000] == (1000, 11) and got[3010] == (0, 1) and got[7] == (0, 3) and got[99_999] == (4000, 1) and got[5001] == (5000, 1)


def test_texts_in_pairs_are_picked_exactly(spark):
    r = random.Random(12)
    every = [0, 1, -1, neardup.PICKS, neardup.PICKS - 1, -neardup.PICKS, 1 << 15, (1 << 63) - 1, -(1 << 63)] + [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(3000)]
    words = spark.createDataFrame([(x, f"t{x}") for x in every], "_id long, words string")
    for some in (every[:9], every[5:400], []):
        ids = spark.createDataFrame([(x,) for x in some], "_id long")
        assert sorted(x["_id"] for x in neardup._picked(words, ids).collect()) == sorted(some)


def test_a_shared_passage_brings_texts_together_where_their_orders_part(spark):
    """Texts of one passage share hundreds of triples; all but a few have the same one before them, and make no rows for the join."""
    passage = prose(90_000, 500)
    words = [(i, f"{prose(91_000 + i, 120)} {passage}") for i in range(60)]
    common = np.zeros(neardup.SLOTS, np.int64)
    for _, grams, _, _ in neardup._small_grams(*neardup._words_of(pa.array([w for _, w in words])), 0.8):
        common += np.bincount((grams % neardup.U64(neardup.SLOTS)).astype(np.int64), minlength=neardup.SLOTS)
    grams, doc, before = neardup.rare_grams(pa.array([w for _, w in words]), common, 0.8)
    rare = spark.createDataFrame([(int(d), int(d), int(g), int(b)) for g, d, b in zip(grams.view(np.int64), doc, before.view(np.int64), strict=True)], "_id long, class long, g long, b long")
    kept = neardup._parting(rare)
    meet = lambda rows: {(x[0], y[0]) for g in rows.values() for x in g for y in g if x[0] > y[0] and (x[1] != y[1] or not x[1])}
    by = lambda df: {k: [(x["_id"], x["b"]) for x in rows] for k, rows in _grouped(df.collect()).items()}
    assert kept.count() < rare.count() / 20
    assert meet(by(kept)) == meet(by(rare)) == {(a, b) for a in range(60) for b in range(a)}


def _grouped(rows):
    out = {}
    for x in rows:
        out.setdefault(x["g"], []).append(x)
    return out


def test_linked_classes_are_not_compared_again(spark, monkeypatch):
    """Two halves of a family in two classes: one pair links them, and none of the others is aligned."""
    base = prose(95_000, 80).split()
    words = [(i, " ".join(edited(base, 0.02, random.Random(i)))) for i in range(40)] + [(100 + i, prose(96_000 + i, 80)) for i in range(2)]
    pairs = [(i, j, i % 2, j % 2, -abs(i - j)) for i in range(40) for j in range(i) if i % 2 != j % 2] + [(101, 100, 101, 100, -5)]
    found = spark.createDataFrame([(i, i % 2 if i < 40 else i, 1) for i, _ in words], "_id long, class long, n_links long")
    aligned, verified = [], neardup._verified

    def counted(pairs, *rest):
        aligned.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "_verified", counted)
    df = spark.createDataFrame(pairs, "_id long, leader long, class long, other long, gap int")
    got = neardup._linked(found, df, spark.createDataFrame(words, "_id long, words string"), 0.8)
    assert {x["_id"]: x["class"] for x in got.collect()} == {i: 0 if i < 40 else i for i, _ in words}
    assert aligned == [2]
