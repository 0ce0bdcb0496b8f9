import random

import numpy as np
import sentencepiece

from tidemark.llm import pieces

MODEL = pieces.compile_model()


def test_ids_are_those_of_the_library():
    t, sp = pieces.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(1)
    bits = list(" abcdeth  \n\t.,{}()=0123é門🦄▁_/#\x00") + ["in", "the", "    ", "er", "tion", "été"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 20)))
        ids = np.frombuffer(t.encode(text), "<i4").tolist()
        assert ids == sp.encode(text), text
        assert t.decode(ids) == text.replace("▁", " ")


def test_unigram_shortest_path():
    vocab = {"a": (1, -1.0), "b": (2, -1.5), "ab": (3, -2.0), "aba": (4, -2.2), "ba": (5, -9.0), "▁": (6, -3.0)}
    t = pieces.Transducer({"bpe": False, "prefix": False, "squeeze": False, "pieces": vocab, "bytes": {b: 10 + b for b in range(256)}, "unknown": 0, "size": 266})

    def best(s):
        if not s:
            return (0.0, [])
        tries = [(best(s[len(p) :])[0] - w, [i, *best(s[len(p) :])[1]]) for p, (i, w) in vocab.items() if s.startswith(p)]
        if s[0] not in vocab:
            tries.append((best(s[1:])[0] + t.floor, [10 + b for b in s[0].encode()] + best(s[1:])[1]))
        return min(tries)

    for s in ("", "abab", "aba", "ababa", "baab", "aéb", "zz", "a b"):
        s = s.replace(" ", "▁")
        assert t.path(s) == best(s)[1]


def test_odd_rows(odd_docs, no_docs):
    rows = pieces.decode(pieces.encode(odd_docs, MODEL), MODEL).collect()
    assert len(rows) == odd_docs.count()
    for x in rows:
        assert x["decoded"] == x["text"] and x["round_trip"] is (None if x["text"] is None else True)
    assert next(x["ids"] for x in rows if x["text"] == "") == [] and next(x["ids"] for x in rows if x["text"] is None) is None
    assert pieces.encode(no_docs, MODEL).collect() == []


def test_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(x["ids"] == sp.encode(docs[x["doc_id"]]) and x["n_ids"] == len(x["ids"]) and x["round_trip"] for x in rows)
