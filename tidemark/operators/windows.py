"""Sliding windows and blocks over the periods of a match.

A period is (match, period, offset, audio_start, audio_end). Windows are anchored at each period's start, and windows without
words are rows too, so Spark's own window() doesn't fit; a word finds its windows by arithmetic instead of a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import WindowConfig
from tidemark.functions.scalar import clock


def pseudo_align(words: DataFrame) -> DataFrame:
    """One period a match for words without event data: from the first word's start to the last word's end."""
    return words.groupBy("match").agg(F.lit(1).alias("period"), F.min("start").alias("offset"), F.min("start").alias("audio_start"), F.max_by("end", F.struct("start", "pos")).alias("audio_end"))


def with_fallback(periods: DataFrame, words: DataFrame) -> DataFrame:
    """periods, and pseudo_align for matches that have none."""
    missing = words.join(periods.select("match").distinct(), "match", "left_anti")
    return periods.select("match", "period", "offset", "audio_start", "audio_end").unionByName(pseudo_align(missing))


def _steps(cfg: WindowConfig) -> Column:
    """The number of the last window of a period."""
    room = F.col("audio_end") + cfg.margin - cfg.length - (F.col("audio_start") - cfg.margin)
    return F.floor((room + 1e-9) / cfg.stride).cast("int")


def window_spine(periods: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """(match, period, k, wid, start, end, t_start) of every window; a period too short for one has none."""
    last = _steps(cfg)
    rows = periods.where(last >= 0).select("match", "period", "offset", "audio_start", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("audio_start") - cfg.margin + F.col("k") * cfg.stride
    wid = F.concat_ws(":", F.col("match").cast("string"), F.col("period").cast("string"), F.format_string("%.1f", start))
    return rows.select("match", "period", "k", wid.alias("wid"), start.alias("start"), (start + cfg.length).alias("end"), (start - F.col("offset")).alias("t_start"))


#: Windows of a period that one task joins from panes.
CHUNK = 720


def sliding_windows(words: DataFrame, periods: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """window_spine with text (words that start in [start, end), in the order of pos, joined and trimmed) and n_words.

    A word goes to one pane of a stride, and a window is the panes it spans, taken from the rows after its first, so a word is
    shuffled once for the panes and once with its pane. Where the length isn't a whole number of strides, a word goes to each of its
    windows.
    """
    panes = round(cfg.length / cfg.stride)
    text = lambda ws: F.trim(F.array_join(F.transform(ws, lambda x: x["word"]), ""))
    p = periods.select("match", "period", (F.col("audio_start") - cfg.margin).alias("_s0"), _steps(cfg).alias("_last"))
    at = words.select("match", "pos", F.col("start").alias("_t"), "word").join(p.where("_last >= 0"), "match")
    if abs(panes * cfg.stride - cfg.length) > 1e-9:
        return _word_by_word(at, periods, cfg, text)
    # the pane is decided on its own bounds, which are the windows' starts
    k = F.floor((F.col("_t") - F.col("_s0")) / cfg.stride).cast("int")
    begins = lambda n: F.col("_s0") + n * cfg.stride
    k = k - F.when(F.col("_t") < begins(k), 1).otherwise(0) + F.when(F.col("_t") >= begins(k + 1), 1).otherwise(0)
    said = at.withColumn("k", k).where((F.col("k") >= 0) & (F.col("k") < F.col("_last") + panes)).select("match", "period", "k", F.struct("pos", "word").alias("w"))
    last = _steps(cfg)
    rest = periods.where((last >= 0) & F.lit(panes > 1)).select("match", "period", F.explode(F.sequence(last + 1, last + panes - 1)).alias("k"))
    rows = window_spine(periods, cfg).unionByName(rest, allowMissingColumns=True).unionByName(said, allowMissingColumns=True)
    kept = ["wid", "start", "end", "t_start"]
    rows = rows.groupBy("match", "period", "k").agg(F.collect_list("w").alias("ws"), *[F.max(c).alias(c) for c in kept])
    # every pane of a period has a row; the first of a chunk are wanted by the last windows of the chunk before too
    chunk = F.floor(F.col("k") / CHUNK).cast("int")
    rows = rows.withColumn("_c", F.explode(F.when((F.col("k") % CHUNK < panes - 1) & (F.col("k") >= CHUNK), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))))
    after = Window.partitionBy("match", "period", "_c").orderBy("k")
    ws = F.array_sort(F.flatten(F.array(*[F.coalesce(F.lead("ws", i).over(after), F.array().cast(rows.schema["ws"].dataType)) for i in range(panes)])))
    out = rows.withColumn("_ws", ws).where((chunk == F.col("_c")) & F.col("wid").isNotNull())
    return out.select("match", "period", "k", *kept, text(F.col("_ws")).alias("text"), F.size("_ws").cast("long").alias("n_words"))


def _word_by_word(at: DataFrame, periods: DataFrame, cfg: WindowConfig, text) -> DataFrame:
    low = F.greatest(F.lit(0), F.floor((F.col("_t") - cfg.length - F.col("_s0")) / cfg.stride).cast("int"))
    high = F.least(F.col("_last"), F.floor((F.col("_t") - F.col("_s0")) / cfg.stride).cast("int"))
    each = at.where(high >= low).select("match", "period", "_t", "pos", "word", "_s0", F.explode(F.sequence(low, high)).alias("k"))
    # the bounds above may take in a window more; membership is decided on the window's own figures
    start = F.col("_s0") + F.col("k") * cfg.stride
    each = each.where((F.col("_t") >= start) & (F.col("_t") < start + cfg.length))
    texts = each.groupBy("match", "period", "k").agg(text(F.array_sort(F.collect_list(F.struct("pos", "word")))).alias("text"), F.count("*").alias("n_words"))
    out = window_spine(periods, cfg).join(texts, ["match", "period", "k"], "left")
    return out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_words", F.coalesce("n_words", F.lit(0)).cast("long"))


def blocks(periods: DataFrame, length: float = 20.0, margin: float = 10.0) -> DataFrame:
    """(match, period, block, start, end, clock): tumbling blocks while they start before the period's end and margin,
    numbered B0001 and on over the periods of a match."""
    s0 = F.col("audio_start") - margin
    n = F.ceil((F.col("audio_end") + margin - s0) / length).cast("int")
    rows = periods.where(n > 0).select("match", "period", "offset", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: s0 + k * length)).alias("start"))
    number = F.row_number().over(Window.partitionBy("match").orderBy("period", "start"))
    return rows.select("match", "period", F.concat(F.lit("B"), F.lpad(number.cast("string"), 4, "0")).alias("block"), "start", (F.col("start") + length).alias("end"), clock(F.col("start") - F.col("offset")).alias("clock"))


def with_prev_text(windows: DataFrame, back: int = 4) -> DataFrame:
    """Adds prev_text: the text `back` windows earlier in the same period, or an empty one."""
    order = Window.partitionBy("match", "period").orderBy("start")
    return windows.withColumn("prev_text", F.lag("text", back, "").over(order))


def match_minutes(points: DataFrame, periods: DataFrame, gap_min: float = 3.0, slack: float = 30.0) -> DataFrame:
    """points (match, id, t) with minutes: time in play with the periods laid end to end, gap_min apart; of periods that take
    t in, within slack seconds, the first counts, and without one it is null."""
    before = Window.partitionBy("match").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    length = (F.col("audio_end") - F.col("audio_start")) / 60 + gap_min
    laid = periods.select(F.col("match").alias("_m"), "period", "offset", "audio_start", "audio_end", F.coalesce(F.sum(length).over(before), F.lit(0.0)).alias("_base"))
    hit = (F.col("match") == F.col("_m")) & (F.col("t") >= F.col("audio_start") - slack) & (F.col("t") <= F.col("audio_end") + slack)
    met = points.join(laid, hit, "left")
    return met.groupBy("match", "id", "t").agg(F.min_by(F.col("_base") + (F.col("t") - F.col("offset")) / 60, "period").alias("minutes"))
