from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import langid


def brute(text: str, train: str) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in train and text[i] in train:
            k += 1
        n, i = n + 1, i + k
    return n


@given(st.text("abc ", max_size=40), st.text("abcd ", max_size=60))
def test_phrases_against_brute_force(train, text):
    assert langid.phrases(text, langid.suffix_automaton(train)) == brute(text, train)


@given(st.lists(st.text("abc ", min_size=1, max_size=40), min_size=1, max_size=3), st.lists(st.text("abcd ", max_size=60), max_size=30), st.booleans())
def test_side_by_side_against_brute_force(trains, texts, alone):
    parser = langid.Parser({str(i): t for i, t in enumerate(trains)})
    if alone:
        parser.table = None
    assert parser.counts(texts).tolist() == [[brute(x, t) for t in trains] for x in texts]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.op3_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in rows if x["held_out"]]
    assert len(rows) == 200 and held
    assert sum(x["lang"] == x["lang_pred"] for x in held) / len(held) >= 0.95
    assert all(0 <= x["score"] <= 1 for x in rows)


def test_odd_rows(odd_docs, no_docs):
    samples = langid.fit(odd_docs)
    assert set(samples) == {"en", "fr"} and all(len(s) <= langid.SAMPLE_CHARS for s in samples.values())
    rows = langid.identify(odd_docs, samples).collect()
    got = {x["doc_id"]: x["lang_pred"] for x in rows}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en" and got[6] == "fr"
    assert langid.identify(odd_docs, {}).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert langid.fit(no_docs) == {} and langid.identify(no_docs, samples).collect() == []


def test_query_rows_against_brute_force(spark):
    """The query's rows from the sample alone: phrases by substring search, estimates, the winner and its score."""
    import math
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    rows = {x["doc_id"]: x for x in langid.op3_language_id(spark, "/root/testdata/sf0.001").collect()}
    texts = sorted(((x["text"] or "", x["doc_id"]) for x in docs.select("doc_id", "text").collect()), key=lambda t: len(t[0]))
    for text, d in texts[:120]:
        letters = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        if not re.search(r"[^\W\d_]", text):
            assert rows[d]["lang_pred"] == "und"
            continue
        e = sorted((brute(letters, s) * math.log2(len(s) + 1), lang) for lang, s in samples.items())
        assert rows[d]["lang_pred"] == e[0][1] and abs(rows[d]["score"] - e[1][0] / (e[0][0] + e[1][0])) < 1e-9, d


def test_large_alphabets_take_little_memory():
    import random

    r = random.Random(2)
    samples = {f"l{k}": "".join(chr(0x4E00 + r.randint(0, 3000)) for _ in range(3000)) + "abc" * 20 for k in range(20)}
    parser = langid.Parser(samples)
    assert parser.table is None and parser.key.nbytes + parser.to.nbytes < 16 * 3 * sum(map(len, samples.values()))
    texts = [samples["l3"][100:160] + "zz" + samples["l4"][:9], "", "abcabc" + samples["l7"][5:30]]
    assert parser.counts(texts).tolist() == [[brute(x, t) for t in samples.values()] for x in texts]
