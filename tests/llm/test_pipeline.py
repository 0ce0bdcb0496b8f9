"""The pipeline against a plain version of its stages on a small corpus."""

import re

import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_neardup import brute_classes
from tidemark.llm import langid, pieces, secrets


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    item = " ".join(f"bench{i}" for i in range(14))
    rows = [(i, prose(i, 60), "en" if i % 2 else None, "s", 1) for i in range(20)]
    rows += [(20, rows[3][1], "en", "s", 1), (21, rows[4][1].replace("oak", "oakx", 1), "en", "s", 1), (22, "12 34 !!", "en", "s", 1), (23, None, "en", "s", 1), (24, "", "en", "s", 1)]
    rows += [(25, prose(90, 30) + " " + item + " " + prose(91, 30), "en", "s", 1)]
    rows += [(30 + i, prose(200 + i, 50) + f' token = "{i:02d}{"0123456789abcdef" * 2}" ' + prose(300 + i, 50), "en", "s", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages_keep_the_columns(spark, corpus):
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_against_a_plain_version(spark, corpus):
    path, rows, item = corpus
    left = {d: t for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    classes = brute_classes(left)
    left = {d: t for d, t in left.items() if classes[d] == d}
    grams = {tuple(item.split()[i : i + 10]) for i in range(5)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    left = {d: t for d, t in left.items() if not any(tuple(words(t)[i : i + 10]) in grams for i in range(len(words(t))))}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(left) and not {20, 21, 22, 23, 24, 25} & set(got)
    for d, r in got.items():
        base = secrets.base_spans(left[d])
        assert r["n_chars"] == len(r["text"]) and r["lang"] == "en" and r["ids"] == sp.encode(r["text"]) and r["round_trip"]
        assert (r["text"] == left[d]) if not base else (corpus_pipeline.REDACTED in r["text"] and "0123456789abcdef" not in r["text"])
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_odd_rows_go_through_all_stages(spark, odd_docs, tmp_path):
    odd_docs.drop("ids").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "same line here same line here same line here same")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without a letter: 1, 2, 3 and one text of 10; 5 repeats 4, a row repeats 6, the null id repeats 8; 9 is the benchmark's
    assert sorted(x["doc_id"] for x in rows) == [4, 6, 7, 8, 10]
    assert all(x["shard"] == 5 and x["kept"] == "x" and x["class_id"] == 9 for x in rows)
    assert next(x["text"] for x in rows if x["doc_id"] == 10) == "another text with the same id"
