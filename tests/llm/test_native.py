import duckdb
import pytest

from tests.llm.conftest import prose
from tidemark.llm import decontaminate, quality, queries

SF = "/root/testdata/sf0.001"


def duck(sql: str, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    found = con.execute(sql)
    cols = [c[0] for c in found.description]
    return cols, sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", ["op8_quality_rules", "op9_decontamination"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in queries.QUERIES[name](spark, SF).collect())


def test_quality_odd_rows(odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for x in rows:
        by.setdefault(x["doc_id"], x)
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["base_failed"]
    assert by[9]["n_dup_lines"] == 29 and by[9]["n_repeat_words"] == 90
    assert by[4]["kept"] and by[4]["n_words"] == 6000
    assert quality.judge(no_docs).collect() == []


def test_shared_lines_deplete(spark):
    rows = [(i, "\n".join([f"the common line of {h} is long enough to matter here"] * 3 + [f"own{i}x{j} some{j}y z{i}{j}{h}" for j in range(80)]), h) for i in range(60) for h in ("a", "b")]
    rows += [(1000 + i, "\n".join([" ".join(f"only{j} boilerplate{j} part{j} stands{j}".split() * 2 + [f"here{j}"]) for j in range(9)]), "c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(x["doc_id"], x["source"]): x for x in quality.judge(docs).collect()}
    assert all(x["n_removed_words"] == 33 and x["kept"] for (d, _), x in got.items() if d < 1000)
    assert all(not x["kept"] and x["n_removed_words"] == x["n_words"] for (d, _), x in got.items() if d >= 1000)


@pytest.mark.parametrize("most", [100_000, 0])
def test_decontaminate_odd_rows(spark, odd_docs, no_docs, most):
    items = spark.createDataFrame([("i1", "another text with"), ("i2", "ÉTÉ"), ("i3", None), ("i4", "!!"), (None, "456"), ("i5", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    more = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(20, "x one, TWO three four five six seven eight nine ten eleven twelve")], "doc_id long, text string"))
    got = {(x["doc_id"], x["n_words"]): sorted(((h["pos"], h["len"], h["item_id"]) for h in x["hits"]), key=str) for x in decontaminate.hit_windows(more, items, most=most).collect()}
    assert got[10, 2] == [(2, 1, None)] and got[10, 6] == [(1, 3, "i1")]
    assert got[20, 13] == [(2, 10, "i5"), (3, 10, "i5")]
    assert not got[1, 0] and not got[6, 8 if (6, 8) in got else next(n for d, n in got if d == 6)]  # only A-Z have cases here
    kept = decontaminate.clean_documents(more, items)
    assert sorted(x["doc_id"] or -1 for x in kept.collect()) == sorted([1, 2, 3, 4, 5, 6, 6, 7, 8, 9, -1])
    assert kept.columns == more.columns
    assert decontaminate.hit_windows(no_docs, items, most=most).collect() == []
    assert all(not x["hits"] for x in decontaminate.hit_windows(more, items.limit(0), most=most).collect())


def test_shared_lines_are_cut(spark):
    rows = [(i, f"Own line {i}\n  The   COMMON line\n\nanother own {i}", "h", 5) for i in range(20)] + [(90, None, "h", 5), (91, "the common line", "g", 5)]
    rows += [(i, rows[i][1], "h", 5) for i in range(3)]  # repeated rows are one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _k int")
    out = quality.without_shared_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {x["doc_id"]: x["text"] for x in out.collect()}
    assert got[3] == "Own line 3\n\nanother own 3" and got[90] is None and got[91] == "the common line"


def test_share_is_of_distinct_documents(spark):
    # 11 of 100 rows, but 11 of 31 documents: with the rows as a base, a share of 0.2 would not be reached
    rows = [(i, f"common line\nown {i}", "h") for i in range(11)] + [(100 + i, f"other {i}", "h") for i in range(20)] + [(200, "same row", "h")] * 69
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_share=0.2).where("n_removed_words > 0")
    assert sorted(x["doc_id"] for x in got.collect()) == list(range(11))


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_spans_and_repeated_documents(spark, tmp_path, most):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"Start, {item.upper()}! End.", "x"), (1, f"Start, {item.upper()}! End.", "x"), (2, "clean text", "y"), (None, item, "z"), (3, None, "n"), (4, "long " * 3000 + item, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k string")
    items = spark.createDataFrame([("a", item), ("b", "w3 w4")], "item_id string, text string")
    got = {(x["doc_id"], x["n_words"]): (len({p for h in x["hits"] for p in range(h["pos"], h["pos"] + h["len"])}), x["times"]) for x in decontaminate.hit_windows(docs, items, most=most).collect()}
    assert got == {(1, 14): (12, 2), (2, 2): (0, 1), (None, 12): (12, 1), (3, 0): (0, 1), (4, 3012): (12, 1)}
    left = decontaminate.remove_spans(docs, items)
    assert left.columns == docs.columns
    assert sorted((str(x["doc_id"]), x["text"]) for x in left.collect() if x["doc_id"] != 3) == sorted([("1", "Start! End."), ("1", "Start! End."), ("2", "clean text"), ("None", ""), ("4", ("long " * 3000).rstrip())])
    assert sorted(str(x["doc_id"]) for x in decontaminate.clean_documents(docs, items).collect()) == ["2", "3"]
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.QUERIES["op9_decontamination"](spark, str(tmp_path)).count() == len(rows)


def test_clean_texts_are_told_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, prose(70_000 + i, 30) if i % 50 else prose(7, 30)) for i in range(1000)] + [(None, None), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(7, 15))], "item_id long, text string")
    bad = decontaminate._hit(docs, items, decontaminate.WINDOW)
    may = decontaminate._told(docs, bad).where("_may")
    assert 20 <= may.count() <= 21 and bad.join(may, ["_k", "_t"]).count() == 20
    kept = decontaminate.clean_documents(docs, items)
    assert kept.count() == 982 and kept.where("doc_id % 50 = 0").count() == 0
    cut = decontaminate.remove_spans(docs, items)
    same = cut.join(docs.withColumnRenamed("text", "was"), "doc_id").where("doc_id <> 5")
    assert cut.count() == 1002 and same.where("text <> was").count() == 20 == same.where("text <> was and doc_id % 50 = 0").count()
