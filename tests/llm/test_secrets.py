import hashlib
import itertools
import random
import re

import numpy as np

from tidemark.llm import secrets


def plainly(text: str) -> list[tuple[int, int, int]]:
    letters = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + letters("api") + "_?" + letters("key")
    out = []
    for k, (rx, group, least) in enumerate(((f"({words})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, m.end()) for m in re.finditer(rx, text) if len(m[group]) >= least]
    return sorted(out)


def test_base_spans():
    r = random.Random(5)
    bits = ["token", "TOKEN", "ſecret", "api_key", "ApiKey", "toKen", " ", "=", ": ", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12", "é", "🦄", "\n", "x" * 6]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert secrets.base_spans(text) == plainly(text), text


def test_decode_is_viterbi():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        emit, move = rng.normal(size=(n, 3)) * rng.choice([1, 8]), rng.normal(size=(3, 3))
        score = lambda y: sum(emit[i, t] for i, t in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023,E731
        best = max(itertools.product(range(3), repeat=n), key=score)
        assert tuple(secrets.decode(emit, move)) == best


def test_training_finds_what_patterns_miss():
    r = random.Random(1)
    filler = lambda: " ".join(r.choice("the of and a green river runs by old stones 4411 12".split()) for _ in range(40))
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f'{filler()} token = "{key(40)}" {filler()}' for _ in range(60)] + [filler() for _ in range(60)]
    weights = secrets.train(texts)
    tagger = secrets.Tagger(weights)
    assert not any(tagger.spans(t) for t in texts[60:])
    odd = f'{filler()} auth = "{key(32).upper()}" {filler()}'
    base, spans = secrets.find(odd, tagger)
    assert not base and [odd[s:e] for s, _, e in spans] == [odd.split('"')[1]]
    assert secrets.train([filler()]) is None


def test_odd_rows(odd_docs, no_docs):
    weights = secrets.fit(odd_docs)
    rows = secrets.scan(odd_docs, weights, redact="#").collect()
    assert len(rows) == odd_docs.count()
    by = {x["doc_id"]: x for x in rows}
    assert by[1]["redacted"] is None and by[2]["redacted"] == "" and by[4]["redacted"] == by[4]["text"]
    assert [s["kind"] for s in by[7]["base"]] == ["assign", "access"]
    assert "hunter2" not in by[7]["redacted"] and "AKIA" not in by[7]["redacted"]
    assert secrets.fit(no_docs) is None and secrets.scan(no_docs, None).collect() == []


def test_query(spark):
    rows = {x["doc_id"]: x for x in secrets.op5_secret_scans(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = plainly(d["text"])
        assert [rows[d["doc_id"]][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in base) for j in range(3)]
        told = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        spans = rows[d["doc_id"]]["spans"]
        assert set(told) <= set(spans.split(","))
        assert rows[d["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        # all spans are the base ones and, in order, those of the field that touch none of them
        parts = [(int(s), secrets.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]
        assert parts == sorted(parts) and [x for x in parts if x[1] < 3] == base
        assert all(e <= a or b <= s for s, k, e in parts if k == 3 for a, _, b in base)


def test_short_texts_train_the_field():
    weights = secrets.train(['password = "hunter2hunter2"'] * 50 + ["hello world"] * 50)
    assert weights is not None and secrets.Tagger(weights).spans('password = "swordfish99x"')


def test_planted_secrets_are_found_and_prose_is_left_alone(spark):
    """Secrets that no base pattern matches, planted in texts of the table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tagger = secrets.Tagger(secrets.fit(docs))
    r = random.Random(3)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [x["text"] for x in docs.orderBy("doc_id").limit(300).collect() if x["text"]]
    found = wrong = 0
    for t in texts:
        words = t.split(" ")
        at, secret = r.randint(0, len(words)), key(40)
        planted = " ".join([*words[:at], f'auth_key = "{secret}"', *words[at:]])
        spans = [planted[s:e] for s, e in tagger.spans(planted)]
        found += any(secret in x or x in secret and len(x) > 20 for x in spans)
        wrong += len(secrets.find(t, tagger)[1]) > len(secrets.base_spans(t))
    print(f"recall {found / len(texts):.3f}, texts with an added span {wrong / len(texts):.3f}")
    assert found / len(texts) >= 0.9 and wrong / len(texts) <= 0.02
