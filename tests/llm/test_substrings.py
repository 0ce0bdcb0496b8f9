import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import substrings


def brute(texts: list[bytes], width: int) -> list[list[bool]]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [5000, 1])
def test_against_brute_force(spark, most):
    r = random.Random(4)
    shared = [prose(s, 12) for s in range(4)]
    texts = []
    for k in range(60):
        parts = [prose(100 + k * 7 + j, r.randint(0, 9)) for j in range(3)]
        texts.append(parts[0] + r.choice(shared)[r.randint(0, 20) :] + parts[1] + r.choice(shared) * r.randint(0, 2) + parts[2])
    texts += ["abab" * 30, "a" * 90, "a" * 31, texts[0], texts[0], "é" * 50, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in substrings.remove_repeated(docs, width=32, seed=7, most=most).collect()}
    raw = [(t or "").encode() for t in texts]
    for k, (t, gone) in enumerate(zip(raw, brute(raw, 32), strict=True)):
        assert bytes(got[k]["kept"]) == bytes(b for b, g in zip(t, gone, strict=True) if not g), k
        assert sum(s["e"] - s["s"] for s in got[k]["removed"]) == sum(gone)


def test_odd_rows(spark, odd_docs, no_docs):
    out = substrings.remove_repeated(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert out.columns == [c for c in odd_docs.columns if c not in ("removed", "kept")] + ["removed", "kept"]
    raw = [(x["text"] or "").encode() for x in rows]
    for x, t, gone in zip(rows, raw, brute(raw, 200), strict=True):
        assert hashlib.sha256(bytes(x["kept"])).digest() == hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).digest()
    assert substrings.remove_repeated(no_docs).collect() == []


def test_periodic_text_is_few_rows():
    for text in (b"a" * 1_000_000, b" " * 50_000, b"abcdefg" * 20_000, b"0123456789" * 50 + prose(1, 200).encode() + b"0123456789" * 50):
        rows = substrings.runs_of(np.frombuffer(text, np.uint8))
        assert len(rows[0]) < 400, len(rows[0])
    start, n, *_, k = substrings.runs_of(np.frombuffer(b"a" * 1_000_000, np.uint8))
    assert [(int(s), int(m)) for s, m, x in zip(start, n, k, strict=True) if x == 0] == [(0, 1_000_000)]


def test_windows_are_compared_by_their_bytes():
    r = random.Random(6)
    for width in (32, 43, 200):
        data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(300)) * 3 + b"x" * 260, np.uint8)
        starts = np.array(r.sample(range(len(data) - width), 400))
        group = np.array([r.randint(0, 3) for _ in starts])
        seen = {}
        for s, g in zip(starts, group, strict=True):
            seen[g, data[s : s + width].tobytes()] = seen.get((g, data[s : s + width].tobytes()), 0) + 1
        want = [seen[g, data[s : s + width].tobytes()] > 1 for s, g in zip(starts, group, strict=True)]
        assert substrings.sort_windows(data, starts, group, width, 8).tolist() == want


def test_doubling_patterns(spark):
    # of such texts, different stretches have equal polynomial fingerprints modulo powers of two
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [thue, thue[700:1500], "b" + thue[3:900], "ab" * 400, prose(5, 90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: bytes(x["kept"]) for x in substrings.remove_repeated(docs).collect()}
    for k, (t, gone) in enumerate(zip(texts, brute([t.encode() for t in texts], 200), strict=True)):
        assert got[k] == bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g), k


def test_windows_of_a_frequent_passage_go_by_blocks(spark):
    """Hundreds of texts around one passage: a row for some windows, not for each, and the same bytes are cut."""
    r, passage = random.Random(31), prose(70_000, 60)
    texts = [prose(71_000 + k, 40) + passage[r.randint(0, 30) :] + prose(72_000 + k, 40) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = [substrings.runs_of(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    rows = [(int(a.view(np.int64)), int(c.view(np.int64)), int(n), int(o), t.encode()[s : s + n + 199]) for t, x in zip(texts, runs, strict=True) for s, n, o, a, c in zip(*x[:5], strict=True)]
    contents = spark.createDataFrame(rows, "a long, c long, n int, off int, bytes binary").dropDuplicates(["a", "c"])
    windows = contents.selectExpr("sum(n)").first()[0]
    assert substrings._blocks(contents, 200).count() < windows / 6
    got = {x["doc_id"]: bytes(x["kept"]) for x in substrings.remove_repeated(docs, most=1).collect()}
    for k, (t, gone) in enumerate(zip(texts, brute([t.encode() for t in texts], 200), strict=True)):
        assert got[k] == bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g), k
