"""Quality rules, with DataFrame functions only: base counts of each text, and lines that too many documents of a host share.

A line is normalised (lower case, white space runs as one blank) and hashed; for each host, the distinct documents with
that line are counted; lines above the limit are taken out, and a document that loses too much of its words goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, written

#: A line is boilerplate if more than this share of its host's documents have it, and more than MIN_DOCS of them.
MAX_SHARE, MIN_DOCS = 0.05, 10
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _repeated(windows: str) -> Column:
    """Words covered by windows that occur twice or more; `windows` names a sorted array of (h, i)."""
    all_ = F.col(windows)
    n = F.size(all_)
    same = lambda j, k: F.get(all_, j)["h"] == F.get(all_, k)["h"]
    twice = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ((j > 0) & same(j, j - 1)) | ((j < n - 1) & same(j, j + 1)))
    return F.sort_array(F.transform(twice, lambda j: F.get(all_, j)["i"]))


def _key(docs: DataFrame, text: str) -> Column:
    return F.xxhash64("doc_id", text, F.coalesce(F.col("source"), F.lit("")))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _k (hash of doc_id, text and source), source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the distinct
    normalised lines as (h, words). A null or empty text has no words and no lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), _key(docs, text).alias("_k"), t.alias("_x"), _words(t).alias("_w"))
    rows = rows.withColumn("n_words", F.size("_w").cast("long"))
    rows = rows.withColumn("word_chars", F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)))
    rows = rows.withColumn("n_symbols", (F.char_length("_x") - F.char_length(F.translate("_x", SYMBOLS, ""))).cast("long"))
    threes = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.sort_array(F.coalesce(threes, F.array().cast("array<struct<h:bigint,i:int>>"))))
    rows = rows.withColumn("_at", F.when(F.size("_s") > 1, _repeated("_s")).otherwise(F.array().cast("array<int>")))
    at = F.col("_at")
    covered = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), p + 3) - p))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, n: a + n))
    lines = F.filter(F.split("_x", "\n"), _has_word)
    rows = rows.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    norm = F.transform("_l", _normal)
    counted = F.transform(norm, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("words")))
    return rows.select("doc_id", "_k", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", counted.alias("lines"))


def _shared_lines(base: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    """(_k, h, words): the lines of each document that too many documents of its host have; words are those of all its copies of the
    line. Written tables, so that Spark splits the rows of a line that a third of all documents have."""
    lines = base.select("_k", "source", F.explode("lines").alias("x")).select("_k", "source", "x.h", "x.words")
    per_doc = written(lines.groupBy("_k", "source", "h").agg(F.sum("words").alias("words")), "quality-lines")
    hosts = base.groupBy("_k", "source").agg(F.lit(1)).groupBy("source").agg(F.count("*").alias("docs"))
    common = per_doc.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    common = written(common.join(hosts, "source").where(F.col("n") > max_share * F.col("docs")).select("source", "h"), "quality-common")
    return per_doc.join(common, ["source", "h"]).select("_k", "h", "words")


def judge(docs: DataFrame, text: str = "text", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """base_counts without lines, with base_failed, n_removed_words and kept.

    Documents are told apart by doc_id, text and source: rows that repeat them are one document, and each gives a row. A null
    source is a host of its own, ''. A line is common if more than a share of its host's documents have it, and more than
    min_docs of them, so that a small host isn't judged by a line or two. Whole texts are counted; other columns aren't read.
    """
    base = written(base_counts(docs, text), "quality-base")
    gone = _shared_lines(base, max_share, min_docs).groupBy("_k").agg(F.sum("words").alias("n_removed_words"))
    times = base.groupBy("_k").agg(F.count("*").alias("_times"))
    gone = gone.join(times, "_k").select("_k", F.expr("n_removed_words div _times").alias("n_removed_words"))
    out = base.drop("lines").join(gone, "_k", "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")))


def without_shared_lines(docs: DataFrame, text: str = "text", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, with its columns, without the lines from text that too many documents of the host have; texts without one, null ones too, stay
    as they are."""
    base = written(base_counts(docs, text).select("_k", "source", "lines"), "quality-base")
    gone = written(_shared_lines(base, max_share, min_docs).groupBy("_k").agg(F.collect_set("h").alias("_gone")), "quality-gone")
    keyed = docs.select(F.struct("*").alias("_row"), _key(docs, text).alias("_k"))
    old = F.col("_row")[text]
    left = F.array_join(F.filter(F.split(old, "\n"), lambda x: ~(_has_word(x) & F.array_contains("_gone", F.xxhash64(_normal(x))))), "\n")
    met = keyed.join(gone, "_k", "left")
    return met.select(*[F.when(F.col("_gone").isNotNull(), left).otherwise(old).alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    out = judge(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE = {
    "op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t, {_W.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS x FROM d),
ll AS (SELECT doc_id, source, x FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM ll GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g WHERE (doc_id, k) IN (SELECT (doc_id, k) FROM g GROUP BY doc_id, k HAVING count(*) > 1)),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM r) GROUP BY doc_id),
nl AS (SELECT doc_id, source, n.k AS k, sum(len(string_split(n.k, ' '))) AS words FROM (SELECT doc_id, source, {{'k': trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'))}} AS n FROM ll) GROUP BY doc_id, source, k),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
c AS (SELECT source, k FROM nl GROUP BY source, k HAVING count(*) > {MIN_DOCS}),
cc AS (SELECT c.source, c.k FROM c JOIN h USING (source) JOIN nl ON nl.source = c.source AND nl.k = c.k GROUP BY c.source, c.k, h.docs HAVING count(*) > {MAX_SHARE} * h.docs),
rm AS (SELECT doc_id, sum(words) AS gone FROM nl JOIN cc USING (source, k) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone
  FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN rm USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= {MIN_LEFT} * n_words AS kept FROM f"""
}
