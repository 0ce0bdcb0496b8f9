"""Replays windows as a stream: written once, let in by time, scored in the stream, folded into highlights as they come."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import names, new_path
from tidemark.sources.sinks import TimelineSink
from tidemark.streaming.highlights import highlights, long_scores

#: Seconds of windows that a replay takes at once.
CELL = 300.0
#: State in RocksDB, which transformWithState needs, with commits as change logs.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The settings of the state store for queries that start meanwhile."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scored_stream(windows: DataFrame, top: str, slices: int, length: float, gap: float, score: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, str]:
    """windows (match, wid, start, end, ...) as a stream in about `slices` batches by time, scored in the stream, and how late a window may
    come in it. The last row is of no match and only moves the watermark past everything."""
    spark = windows.sparkSession
    rows = windows.withColumn("at", F.timestamp_seconds("end"))
    if "latency_ms" not in rows.columns:
        rows = rows.withColumn("latency_ms", F.lit(None).cast("double"))
    rows.write.parquet(f"{top}/all")
    rows = spark.read.schema(rows.schema).parquet(f"{top}/all")
    ends = rows.agg(F.min("end").alias("a"), F.max("end").alias("b")).first()
    first, last = ends["a"] or 0.0, ends["b"] or 0.0
    span = (last - first) / slices + 1
    stop = last + span + CELL + gap + 2 * length + 2
    end = rows.select(*[(F.lit(stop) if c == "end" else F.timestamp_seconds(F.lit(stop)) if c == "at" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes]).limit(1)
    for k in range(slices):
        part = rows.where(F.floor((F.col("end") - first) / span) == k)
        (part.union(end) if k == slices - 1 else part).write.mode("append").parquet(f"{top}/in")
    each = max(1, -(-sum(n.endswith(".parquet") for n in names(spark, f"{top}/in")) // slices))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{top}/in")
    return (score(source) if score else source), f"{int(span) + 1} seconds"


def _found(windows: DataFrame, top: str, questions: list[str], thresholds: dict[str, float], gap: float, max_len: float, slices: int, length: float, score, traced: str | None = None) -> DataFrame:
    stream, late = scored_stream(windows, top, slices, length, gap, score)
    return highlights(long_scores(stream, questions), thresholds, gap, max_len, length, late, traced, CELL)


def run(windows: DataFrame, questions: list[str], thresholds: dict[str, float], gap: float = 30.0, max_len: float = 120.0, slices: int = 2, length: float = 20.0, score: Callable[[DataFrame], DataFrame] | None = None, name: str | None = None) -> DataFrame:
    """Highlights of windows (match, wid, start, end, and a column a question, or what `score` makes such columns of) after all of them
    went by in one query. score gets the stream: a scorer or saved predictions (streaming.scoring) work there. name is what
    streaming.progress knows the query by. An empty table has no highlights."""
    spark = windows.sparkSession
    top = new_path(spark, "replay")
    with rocks(spark):
        found = _found(windows, top, questions, thresholds, gap, max_len, slices, length, score)
        query = found.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").queryName(name or f"replay-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{top}/out").drop("kind")


def timeline(windows: DataFrame, questions: list[str], thresholds: dict[str, float], traced: str, gap: float = 30.0, max_len: float = 120.0, slices: int = 2, length: float = 20.0, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(match, json) after all windows went by; the table grows with every batch of the stream (see sinks.TimelineSink). traced is a
    question whose scores are told window by window."""
    spark = windows.sparkSession
    top = new_path(spark, "timeline")
    sink = TimelineSink(f"{top}/timelines", thresholds)
    with rocks(spark):
        found = _found(windows, top, questions, thresholds, gap, max_len, slices, length, score, traced)
        found.writeStream.foreachBatch(sink.take).option("checkpointLocation", f"{top}/state").queryName(f"timeline-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark)


def collected(stream: DataFrame, top: str) -> DataFrame:
    """What a stream of paced.stream brings until its last slot is out, as a table. A run that is started anew with the same top goes on
    from its checkpoint."""
    from tidemark.streaming.paced import ended

    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(processingTime="200 milliseconds").start()
    try:
        while query.isActive and not ended(top, query.lastProgress):
            query.awaitTermination(1)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")
