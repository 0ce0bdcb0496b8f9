from collections import Counter

from tidemark.llm import tokencounts as tc
from tidemark.llm.common import shared_path


def words():
    return lambda t: len(t.split())


def chars():
    return len


def totals(rollup):
    return {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in rollup.totals().collect()}


def test_batches(spark, odd_docs, no_docs):
    rollup = tc.TokenRollup(spark, shared_path(spark, "test-rollup"))
    assert totals(rollup) == {}
    counts = tc.counted(odd_docs, "words", words)
    assert rollup.insert("one", counts)
    want = {}
    for d in odd_docs.collect():
        n, k = want.get((d["source"], d["lang"], "words"), (0, 0))
        want[d["source"], d["lang"], "words"] = (n + 1, k + len((d["text"] or "").split()))
    assert totals(rollup) == want
    assert not rollup.insert("one", counts) and totals(rollup) == want
    assert rollup.insert("none", tc.counted(no_docs, "words", words)) and totals(rollup) == want
    assert rollup.delete("gone", spark.createDataFrame([(6,), (10,), (999,)], "doc_id long"))
    gone = Counter()
    for d in odd_docs.where("doc_id in (6, 10)").collect():
        n, k = want[d["source"], d["lang"], "words"]
        want[d["source"], d["lang"], "words"] = (n - 1, k - len(d["text"].split()))
        gone[d["doc_id"]] += 1
    want = {k: v for k, v in want.items() if v != (0, 0)}
    assert gone == {6: 2, 10: 2} and totals(rollup) == want
    assert not rollup.delete("gone", spark.createDataFrame([(6,)], "doc_id long"))
    again = odd_docs.where("doc_id = 4").withColumn("text", odd_docs["source"])
    assert rollup.revise("less", tc.counted(again, "words", words), "words")
    n, k = want["a", "en", "words"]
    want["a", "en", "words"] = (n, k - 6000 + 1)
    assert totals(rollup) == want


def test_commit_that_died_halfway(spark, odd_docs):
    rollup = tc.TokenRollup(spark, shared_path(spark, "test-rollup"))
    counts = tc.counted(odd_docs, "chars", chars)
    rollup.insert("a", counts)
    # a batch without its marker isn't counted, and is written anew
    counts.withColumn("sign", tc.F.lit(1)).write.parquet(f"{rollup.folder}/ledger/b")
    before = totals(rollup)
    assert rollup.insert("b", counts)
    assert totals(rollup) == {k: (2 * n, 2 * t) for k, (n, t) in before.items()}


def test_signs_take_each_other_back(spark):
    rollup = tc.TokenRollup(spark, shared_path(spark, "test-rollup"))
    rows = [(1, "a", "en", "words", 1, 5), (1, "a", "en", "words", -1, 3), (2, "a", "en", "words", 3, 4), (None, "a", "en", "words", 1, 7)]
    assert rollup.commit("signs", spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long"))
    assert totals(rollup) == {("a", "en", "words"): (4, 21)}
    assert rollup.delete("one", spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert totals(rollup) == {("a", "en", "words"): (4, 19)}
    assert rollup.delete("two", spark.createDataFrame([(2,), (2,)], "doc_id long"))
    assert totals(rollup) == {("a", "en", "words"): (1, 7)}


def test_compaction_and_two_writers(spark, odd_docs):
    rollup, other = (tc.TokenRollup(spark, shared_path(spark, "test-rollup")) for _ in range(2))
    other.folder = rollup.folder
    counts = tc.counted(odd_docs, "chars", chars)
    rollup.insert("a", counts)
    before = totals(rollup)
    # a second writer that began before the marker was there
    signed = counts.withColumn("n_docs", tc.F.lit(1).cast("long"))
    assert not other._commit("a", signed) and totals(rollup) == before
    rollup.compact()
    assert totals(rollup) == before and rollup.batches() == ["a"] and not rollup.insert("a", counts)
    rollup.insert("b", counts)
    assert totals(rollup) == {k: (2 * n, 2 * t) for k, (n, t) in before.items()}
    rollup.delete("c", odd_docs)
    rollup.compact()
    left = odd_docs.where("doc_id is null").collect()
    assert totals(rollup) == {(x["source"], x["lang"], "chars"): (2, 2 * len(x["text"])) for x in left}


def test_query(spark):
    rows = tc.op2_token_counts(spark, "/root/testdata/sf0.001").collect()
    docs = {x["doc_id"]: x for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    toxic = {x["doc_id"] for x in labels if x["toxic"] == 1}
    good = {x["doc_id"] for x in labels if x["quality"] == 1 and x["toxic"] == 0}
    a = tc.Tokenizer(f"{tc.TOKENIZERS}/byte_bpe_50k.tiktoken", "tiktoken")()
    b = tc.Tokenizer(f"{tc.TOKENIZERS}/piece_bpe_32k.model", "sentencepiece")()
    want: dict = {}
    for d in docs.values():
        if d["doc_id"] not in toxic:
            for name, n in (("byte_bpe_50k", a(d["text"].strip(" ") if d["doc_id"] in good else d["text"])), ("piece_bpe_32k", b(d["text"]))):
                k, t = want.get((d["source"], d["lang"], name), (0, 0))
                want[d["source"], d["lang"], name] = (k + 1, t + n)
    assert {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in rows} == want


def test_a_writer_that_dies_while_it_marks(spark, monkeypatch):
    """What a dead writer leaves is no marker, so the batch is committed by the next one."""
    rollup = tc.TokenRollup(spark, shared_path(spark, "test-rollup"))
    rows = spark.createDataFrame([(1, "a", "en", "words", 1, 5)], "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long")
    assert rollup.commit("one", rows)

    def dies(session, path, content):
        folder, name = path.rsplit("/", 1)
        store, at = rollup._fs(f"{folder}/.{name}.dead")
        store.create(at, True).close()
        raise RuntimeError

    real = tc.publish
    monkeypatch.setattr(tc, "publish", dies)
    try:
        rollup.commit("two", rows)
        raise AssertionError
    except RuntimeError:
        pass
    monkeypatch.setattr(tc, "publish", real)
    assert rollup.batches() == ["one"] and totals(rollup) == {("a", "en", "words"): (1, 5)}
    assert rollup.commit("two", rows) and not rollup.commit("two", rows)
    assert totals(rollup) == {("a", "en", "words"): (2, 10)}


def test_a_commit_while_batches_are_packed(spark, monkeypatch):
    rollup = tc.TokenRollup(spark, shared_path(spark, "test-rollup"))
    row = lambda n: spark.createDataFrame([(n, "a", "en", "words", 1, n)], "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long")
    rollup.commit("one", row(5))
    write, inside = rollup._write, []

    def meanwhile(signed):
        if not inside:
            inside.append(True)
            rollup.commit("two", row(7))
        return write(signed)

    monkeypatch.setattr(rollup, "_write", meanwhile)
    rollup.compact()
    assert totals(rollup) == {("a", "en", "words"): (2, 12)}
    rollup.delete("gone", spark.createDataFrame([(7,)], "doc_id long"))
    rollup.compact()
    rollup.compact()
    rollup.clean()
    assert totals(rollup) == {("a", "en", "words"): (1, 5)} and not rollup.commit("two", row(7))
    rollup.commit("three", row(9))
    assert totals(rollup) == {("a", "en", "words"): (2, 14)}
