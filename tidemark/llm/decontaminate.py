"""Benchmark decontamination, with DataFrame functions only.

The windows of all test items (10 words, or the whole item if it is shorter) are 64-bit hashes, and the set of them is
broadcast. Training texts are scanned window by window where they lie; only windows whose hash is in the set leave their task,
and they are verified word by word against the items. A set of more than SET_SIZE hashes is cut into several, and the texts
are scanned once for each, so what a task holds is bounded and texts are never shuffled, however many items there are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, written

WINDOW = 10
#: Hashes in one broadcast set (about 40 bytes each, so 40 MB).
SET_SIZE = 1_000_000
#: Words of a text that are scanned as one row, so that long texts take no more memory than short ones.
BLOCK = 1024
#: Bits of the table by which most texts without a hit are told without a shuffle (of fixed size, 2 MB, that every task holds).
BITS = 1 << 24
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that isn't lower-cased, with what parts it from the word before; or what is left at the end.
_TOKEN = r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, len, key, hash): the distinct windows of each item; null and wordless items have none."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    spans = words.withColumn("len", F.least(F.size("w"), F.lit(window))).select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    cut = F.slice("w", F.col("i"), F.col("len"))
    # the hash of a window is that of its words' hashes, one after another
    return spans.select("item_id", "len", F.array_join(cut, " ").alias("key"), F.xxhash64(F.transform(cut, lambda w: F.xxhash64(w))).alias("hash")).distinct()


def _windows_of(docs: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """A row for each window of each text: doc_id, _t, _k, n_words, words of its block (w), its place there (i) and in the text (pos),
    len and hash; and one of place 0 for each row of docs."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("_t"), F.xxhash64("doc_id", text).alias("_k"), words_of(F.col(text)).alias("_w")).withColumn("n_words", F.size("_w").cast("long"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(BLOCK))
    cut = F.transform(starts, lambda a: F.struct(a.alias("at"), F.slice("_w", a + 1, BLOCK + lengths[-1] - 1).alias("w")))
    blocks = rows.select("doc_id", "_t", "_k", "n_words", F.explode(cut).alias("b")).select("doc_id", "_t", "_k", "n_words", "b.at", "b.w")
    blocks = blocks.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    first = F.when(F.col("at") == 0, 0).otherwise(1)
    each = blocks.select("*", F.explode(F.sequence(first, F.least(F.lit(BLOCK), F.size("w")))).alias("i"))

    def hash_(n: int) -> Column:
        inside = (F.col("i") > 0) & (F.col("i") + (n - 1) <= F.size("h"))
        return F.when(inside, F.xxhash64(*[F.get("h", F.col("i") + (k - 1)) for k in range(n)]))

    if len(lengths) == 1:
        each = each.withColumn("len", F.lit(lengths[0])).withColumn("hash", hash_(lengths[0]))
    else:
        both = F.array(*[F.struct(F.lit(n).alias("len"), hash_(n).alias("hash")) for n in lengths])
        each = each.select("*", F.explode(both).alias("x")).select("*", "x.len", "x.hash").drop("x")
    return each.where(F.col("hash").isNotNull() | (F.col("i") == 0) & (F.col("len") == lengths[0])).withColumn("pos", F.col("at") + F.col("i"))


def hit_windows(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, most: int = SET_SIZE) -> DataFrame:
    """doc_id, _t, _k, n_words, the verified hits [(pos, len, item_id)] of each document (empty if none), and how many rows (times) it
    has in docs.

    Documents are told apart by doc_id and text, so rows that repeat both are one here, with their number; one doc_id with two
    texts is two. A null text has no words, and a long one is scanned in blocks. Neither table need have rows; other columns
    aren't read. `most` bounds the hashes of one broadcast set.
    """
    windows = written(item_windows(items, window), "bench-windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect()) or [window]
    hashes = windows.select("hash").distinct()
    parts = max(1, -(-hashes.count() // max(1, most)))
    found = None
    for part in range(parts):
        held = hashes.where(F.pmod("hash", F.lit(parts)) == part).withColumn("_in", F.lit(True))
        met = _windows_of(docs, text, lengths).join(F.broadcast(held), "hash", "left")  # `most` hashes
        met = met.where(F.col("_in").isNotNull() | (F.col("i") == 0) if part == 0 else F.col("_in").isNotNull())
        key = F.when(F.col("i") > 0, F.array_join(F.slice("w", F.when(F.col("i") > 0, F.col("i")).otherwise(1), F.col("len")), " "))
        met = met.select("doc_id", "_t", "_k", "n_words", "pos", "len", key.alias("key"))
        found = met if found is None else found.unionByName(met)
    found = written(found, "bench-hits")
    every = found.where("key is null").groupBy("doc_id", "_t", "_k", "n_words").agg(F.count("*").alias("times"))
    hits = found.where("key is not null").join(windows.select("len", "key", "item_id"), ["len", "key"])
    hits = hits.groupBy("_k", "_t").agg(F.collect_set(F.struct("pos", "len", "item_id")).alias("hits"))
    none = F.array().cast(hits.schema["hits"].dataType)
    return every.join(hits, ["_k", "_t"], "left").select("doc_id", "_t", "_k", "n_words", F.coalesce("hits", none).alias("hits"), "times")


def _places(hits: Column) -> Column:
    """The words that lie in any hit, from 1."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, the words inside any occurrence of an item's window, and the items that occur. Repeated documents give
    a row each; items with a null id count as one, without a name in the hash."""
    hits = hit_windows(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hits = hits.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    out = hits.select("doc_id", "n_words", F.size(_places(F.col("hits"))).cast("long").alias("n_hit"), ids.alias("i"))
    return out.select("doc_id", "n_words", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _hit(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(_k, _t, hits) of documents with a hit; written, so that Spark knows its size when it plans the join with the texts."""
    return written(hit_windows(docs, items, window=window).where(F.size("hits") > 0).select("_k", "_t", "hits"), "bench-contaminated")


def _told(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """(_row, _k, _t, _may) of docs; where _may is false, bad (_k, _t) doesn't have the text. So only the others need a join by key."""
    slot = F.pmod("_k", F.lit(BITS))
    number, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    table = bad.groupBy(number.alias("_n")).agg(F.bitmap_construct_agg(bit).alias("_b"))
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_k"), F.xxhash64("text").alias("_t"))
    byte = F.conv(F.hex(F.substring("_b", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = keyed.withColumn("_n", number).join(F.broadcast(table), "_n", "left")
    return met.select("_row", "_k", "_t", F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False)).alias("_may"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs whose text has no window of an item, with the columns of docs; repeated rows all stay or all go."""
    bad = _hit(docs, items, window).select("_k", "_t")
    keyed = _told(docs, bad)
    left = keyed.where("_may").join(bad, ["_k", "_t"], "left_anti")
    return keyed.where("not _may").select("_row.*").unionByName(left.select("_row.*"))


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of docs, with its columns; from text, the words inside any hit are cut out, each with what parts it from the word
    before. Texts without a hit, null ones too, stay as they are."""
    bad = _hit(docs, items, window).select("_k", "_t", _places(F.col("hits")).alias("_at"))
    keyed = _told(docs, bad)
    text = F.col("_row.text")
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    left = F.array_join(F.filter(tokens, lambda _, j: ~F.array_contains("_at", j + 1)), "")
    met = keyed.where("_may").join(bad, ["_k", "_t"], "left")
    met = met.select(*[F.when(F.col("_at").isNotNull(), left).otherwise(text).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
    return keyed.where("not _may").select("_row.*").unionByName(met)


_A, _B = string.ascii_uppercase, string.ascii_lowercase
ORACLE = {
    "op9_decontamination": f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_A}', '{_B}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_A}', '{_B}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
ns AS (SELECT DISTINCT n FROM ik),
dk AS (SELECT doc_id, n, i, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dk.n, i, item_id FROM dk JOIN ik ON dk.n = ik.n AND dk.k = ik.k),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
