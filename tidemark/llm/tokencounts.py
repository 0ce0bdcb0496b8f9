"""Token counts by source, language and tokenizer, kept as sums of committed batches of signed changes.

A batch holds, for each document that came, went or was recounted, a signed number of documents and of tokens. Committing it
appends its sums (the delta) and its rows (the ledger, from which later deletions and recounts know what to take back) in
folders of that attempt's own, and then puts a marker that names the attempt in place by one rename. A marker can be put once, so a
repeated commit changes nothing, of two writers one wins, and an attempt that died is never read and may be made again. Totals add deltas up and never read
texts or the ledger. The ledger lies in BUCKETS by document, and compact() puts all committed batches into one.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, shared_path
from tidemark.sources.shared import publish

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pattern that cuts text before byte-level merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
ROW = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Folders of the ledger by document: a change reads those of its documents.
BUCKETS = 64
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class Tokenizer:
    """A tokenizer file; called in a task, it gives a function from a text to its number of tokens."""

    def __init__(self, path: str, kind: str):
        self.kind = kind
        with open(path, "rb") as f:
            self.data = f.read()

    def __call__(self):
        if self.kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.data.splitlines() if line)}
            enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda t: len(enc.encode_ordinary(t))
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return lambda t: len(sp.encode(t, num_threads=1))


_made: dict = {}


def counted(docs: DataFrame, version: str, make, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every row; a null or empty text has no tokens."""
    held = docs.sparkSession.sparkContext.broadcast(make)  # what makes the tokenizer: one vocabulary

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if version not in _made:
            _made.clear()
            _made[version] = held.value()
        n = _made[version]
        for texts in batches:
            yield pd.Series([n(t) if t else 0 for t in texts], dtype="int64")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("tokenizer"), count(F.col(text)).alias("n_tokens"))


class TokenRollup:
    """Totals under one folder. Any number of writers may commit, and readers read, at any time; a deletion or recount takes back
    what was committed when it began."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _there(self, path: str) -> bool:
        store, at = self._fs(path)
        return store.exists(at)

    def _named(self, kind: str) -> dict[str, str]:
        """Content of the files in a folder, by name."""
        if not self._there(f"{self.folder}/{kind}"):
            return {}
        rows = self.spark.read.text(f"{self.folder}/{kind}", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
        return {r["name"]: r["value"] for r in rows}

    def _state(self) -> tuple[list[str], list[str]]:
        """Folders to read, of the last compaction and of the batches committed since; and the names of all those batches. Compactions are
        listed first, so none names a batch that isn't there."""
        packed, done = self._named("compacted"), self._named("committed")
        if not packed:
            return sorted(done.values()), sorted(done)
        attempt, *inside = packed[max(packed)].split("\n")
        return [attempt, *sorted(a for b, a in done.items() if b not in set(inside))], sorted(done)

    def batches(self) -> list[str]:
        """Names of committed batches."""
        return sorted(self._named("committed"))

    def _read(self, what: str, schema: str, attempts: list[str] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{what}/attempt={a}" for a in (self._state()[0] if attempts is None else attempts)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{what}").parquet(*paths)
        return rows.select(*[c.split()[0] for c in schema.split(", ")])

    def _write(self, signed: DataFrame) -> str:
        """Rows of ROW and their sums, as an attempt that no marker names yet."""
        attempt = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        signed.select("doc_id", *KEYS, "n_docs", "n_tokens", bucket.alias("b")).hint("rebalance", "b").write.partitionBy("b").parquet(f"{self.folder}/ledger/attempt={attempt}")
        rows = self.spark.read.schema(ROW).parquet(f"{self.folder}/ledger/attempt={attempt}")
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.folder}/delta/attempt={attempt}")
        return attempt

    def _commit(self, batch: str, signed: DataFrame) -> bool:
        return publish(self.spark, f"{self.folder}/committed/{batch}", self._write(signed))

    def _done(self, batch: str) -> bool:
        return self._there(f"{self.folder}/committed/{batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (doc_id, source, lang, tokenizer, sign, n_tokens), sign any integer. False if that batch is there
        already. Other columns are left out."""
        sign = F.col("sign").cast("long")
        return not self._done(batch) and self._commit(batch, changes.select("doc_id", *KEYS, sign.alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens")))

    def insert(self, batch: str, counts: DataFrame) -> bool:
        """Adds documents; a repeated row is one more document. A null doc_id counts, but can't be taken back by name."""
        return self.commit(batch, counts.withColumn("sign", F.lit(1)))

    def _back(self, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
        """One row for each document, key and tokenizer that takes back what it counts for."""
        wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        buckets = [r["b"] for r in wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # BUCKETS at most
        rows = self._read("ledger", ROW + ", b int").where(F.col("b").isin(buckets))
        rows = rows.where(F.col("tokenizer") == tokenizer) if tokenizer else rows
        # only rows of these documents are summed
        now = rows.join(wanted, "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg((-F.sum("n_docs")).alias("n_docs"), (-F.sum("n_tokens")).alias("n_tokens"))
        return now.where("n_docs <> 0 or n_tokens <> 0")

    def delete(self, batch: str, docs: DataFrame) -> bool:
        """Takes documents (doc_id) back, under all tokenizers; unknown and null ones change nothing."""
        return not self._done(batch) and self._commit(batch, self._back(docs))

    def revise(self, batch: str, counts: DataFrame, tokenizer: str) -> bool:
        """Replaces the counts of documents under one tokenizer: takes back what is there, and adds the new ones."""
        if self._done(batch):
            return False
        new = counts.select("doc_id", *KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        return self._commit(batch, self._back(counts, tokenizer).unionByName(new))

    def compact(self) -> None:
        """Puts the batches committed so far into one, with a row a document and key, which later reads take in their place."""
        attempts, names = self._state()
        rows = self._read("ledger", ROW, attempts).groupBy("doc_id", *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        attempt = self._write(rows.where("n_docs <> 0 or n_tokens <> 0"))
        publish(self.spark, f"{self.folder}/compacted/{len(names):09d}-{attempt}", "\n".join([attempt, *names]))

    def clean(self) -> None:
        """Deletes what only readers that began before the last compaction but one can still read."""
        packed, done = self._named("compacted"), self._named("committed")
        kept = set(sorted(packed)[-2:])
        if len(kept) < 2:
            return
        old = packed[min(kept)].split("\n")
        gone = [done[b] for b in old[1:] if b in done] + [packed[n].split("\n")[0] for n in packed if n not in kept]
        for path in [f"{self.folder}/{what}/attempt={a}" for a in gone for what in ("ledger", "delta")] + [f"{self.folder}/compacted/{n}" for n in packed if n not in kept]:
            store, at = self._fs(path)
            store.delete(at, True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of groups that hold a document. Null sources and languages are groups."""
        sums = self._read("delta", DELTA).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def op2_token_counts(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Totals after four batches: all documents by one tokenizer, all by another, toxic ones taken back, and the counts of
    the documents with a quality label revised (recounted on trimmed text); the second batch is sent twice."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    rollup = TokenRollup(spark, shared_path(spark, "token-counts"))
    bytes_ = Tokenizer(f"{folder}/byte_bpe_50k.tiktoken", "tiktoken")
    pieces = Tokenizer(f"{folder}/piece_bpe_32k.model", "sentencepiece")
    rollup.insert("load", counted(docs, "byte_bpe_50k", bytes_))
    rollup.insert("second-tokenizer", counted(docs, "piece_bpe_32k", pieces))
    rollup.insert("second-tokenizer", counted(docs, "piece_bpe_32k", pieces))
    rollup.delete("toxic", labels.where("toxic = 1"))
    # counts are joined, not texts; a semi join would be moved below the counting and shuffle them
    good = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()
    rollup.revise("trimmed", counted(docs.withColumn("text", F.trim("text")), "byte_bpe_50k", bytes_).join(good, "doc_id"), "byte_bpe_50k")
    return rollup.totals()
