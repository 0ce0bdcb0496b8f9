"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import load

SHARDS = 24
#: Rows of a shard are numbered within this many buckets each, so that no task sorts a whole shard.
SLOT_BUCKETS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach, 2014); going from n to n + 1 shards, keys only move into shard n."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(moving):
            shard[moving] = jump[moving]
            key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            drawn = (key[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[moving] = ((shard[moving] + 1) * (float(1 << 31) / drawn)).astype(np.int64)
            moving = moving[jump[moving] < shards]
    return shard


def shard_of(key, shards: int):
    """Column: the shard of an integer key column; a null key counts as 0."""

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return jumped(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """df with shard, grown_shard (of one more shard) and slot (0, 1, ... within the shard, no gap).

    A null key counts as key 0. Repeated rows stay apart: each gets a slot of its own. Slots are given by bucket of the
    row's hash and then by the row's columns; numbering is by bucket, and the buckets' first slots come from
    shards x buckets counts, a fixed number, which is why they may be broadcast. Input columns named shard, slot or
    grown_shard are replaced. An empty table gives an empty one.
    """
    cols = [c for c in df.columns if c not in ("shard", "grown_shard", "slot")]
    keyed = df.select(*cols).withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*cols)
    out = keyed.withColumn("_at", F.row_number().over(within)).join(F.broadcast(first), ["shard", "_bucket"])
    return out.select(*cols, "shard", "grown_shard", (F.col("_first") + F.col("_at") - 1).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards; doc_id and the number of shards decide (law key)."""
    docs = load(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = assign_shards(sized, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
