import bisect
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import additive as a

SF = "/root/testdata/sf0.01"


def plain(text: str | None) -> dict[str, float]:
    """FEATURES in plain Python."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / max(len(raw), 1)
    n = max(len(words), 1)
    out = {name: share(chars) for name, chars in a._CLASSES.items()}
    out |= {"words": math.log1p(len(words)), "word_bytes": sum(map(len, words)) / n, "longest": math.log1p(max(map(len, words), default=0))}
    out |= {"sentence_ends": sum(w[-1:] in b".?!" for w in words) / n, "repeats": sum(x == y for x, y in zip(words, words[1:], strict=False)) / n, "distinct": len(set(words)) / n}
    return out | {"lines": len(lines) / n, "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0}


@settings(deadline=None)
@given(st.lists(st.text("aB9é \n\t.!|", max_size=30) | st.none(), max_size=8))
def test_features(texts):
    got = a.features(pa.array(texts, pa.string()))
    assert np.allclose(got, np.array([[plain(t)[f] for f in a.FEATURES] for t in texts]).reshape(-1, len(a.FEATURES)))


def by_hand(model: a.Additive, x: list[float]) -> float:
    total = model.intercept + sum(t[bisect.bisect_right(c.tolist(), v)] for c, t, v in zip(model.cuts, model.tables, x, strict=True))
    total += sum(t[bisect.bisect_right(p.tolist(), x[i])][bisect.bisect_right(q.tolist(), x[j])] for i, j, p, q, t in model.pairs)
    return 1 / (1 + math.exp(-total))


def test_query_rows_and_held_out_accuracy(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = a.fit(table, labels.where(~a.held_out(labels["doc_id"])))
    rows = a.op11_quality_classifier(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
        assert abs(r["score"] - by_hand(model, [plain(docs[r["doc_id"]])[f] for f in a.FEATURES])) < 1e-9
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert held and sum(x == y for x, y in held) / len(held) >= 0.93


def test_pairs_learn_what_no_feature_shows():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = a.boost(x, y, rounds=20, pair_rounds=40, pairs=2)
    assert model.pairs[0][:2] == (0, 1)
    test = r.random((1000, 3))
    assert ((model.score(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))).mean() > 0.95
    assert (a.boost(x, y, rounds=20, pairs=0).score(test) > 0.5).std() < 0.51 and not a.boost(x, y, rounds=2, pairs=0).pairs


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (7, 0, 1, "x"), (7, 0, 1, "x"), (None, 1, 0, "x"), (9, None, 0, "x"), (6, 1, 0, "x"), (77, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    model = a.fit(odd_docs, labels)
    df = odd_docs.withColumnRenamed("shard", "score").withColumnRenamed("ids", "predicted")
    rows = a.score(df, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by_text = {}
    assert all(by_text.setdefault(r["text"] or "", r["score"]) == r["score"] for r in rows)
    assert a.score(no_docs, model).collect() == []
    untaught = a.fit(no_docs, labels)
    assert {r["score"] for r in a.score(odd_docs, untaught).collect()} == {0.5}


def test_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = []
    boost, a.boost = a.boost, lambda x, y: seen.append(len(y)) or boost(x, y, rounds=1, pair_rounds=1)
    try:
        a.fit(docs.union(docs), labels, max_rows=50)
    finally:
        a.boost = boost
    assert seen == [50]
