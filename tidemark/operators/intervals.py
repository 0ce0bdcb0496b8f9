"""Joins of intervals. Every one has an equality on the stream (and question), so Spark hashes or sorts on that, and
overlapping pairs meet by the time cell they share, so the work grows with the overlaps and not with the product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import gap, overlap


def _cells(start: Column, end: Column, cell: float) -> Column:
    return F.sequence(F.floor(start / cell).cast("long"), F.floor(end / cell).cast("long"))


def cell_for(left: DataFrame, right: DataFrame, reach: float = 0.0) -> float:
    """A time cell twice as long as the intervals of either side are on average, reach included; so each side has one and a half rows an
    interval, whatever their lengths and outliers."""
    mean = lambda df, more: (df.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0.0) + more
    return max(1e-3, 2 * max(mean(left, 2 * reach), mean(right, 0.0)))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], reach: float = 0.0, cell: float | None = None) -> DataFrame:
    """Rows of left with rows of right (their start and end as r_start and r_end, other columns kept) that lie less than
    `reach` apart, touch or overlap. Both have start and end; pairs come once: in the first cell that both are in. Without a
    cell its length is measured (cell_for)."""
    cell = cell or cell_for(left, right, reach)
    a = left.withColumn("_cell", F.explode(_cells(F.col("start") - reach, F.col("end") + reach, cell)))
    b = right.withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end").withColumn("_cell", F.explode(_cells(F.col("r_start"), F.col("r_end"), cell)))
    met = a.join(b.hint("merge"), [*keys, "_cell"])  # neither side is bounded; Spark takes what was exploded for as many rows as before
    first = F.greatest(F.floor((F.col("start") - reach) / cell), F.floor(F.col("r_start") / cell))
    close = (F.col("r_start") <= F.col("end") + reach) & (F.col("r_end") >= F.col("start") - reach)
    return met.where(close & (F.col("_cell") == first)).drop("_cell")


def _shared() -> Column:
    return overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))


def project(windows: DataFrame, spans: DataFrame, questions: DataFrame, min_overlap: float = 3.0, ignore_near: float = 10.0, ignored: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """(match, wid, question, label) of every window and question: 1 if it overlaps a span by min_overlap or more, null if by
    less or if a span is nearer than ignore_near, else 0. A touch is an overlap of 0 and a gap of 0. With ignored spans, a 0
    becomes null where the window overlaps one; both kinds of span meet the windows in one pass."""
    w = windows.select("match", "wid", "start", "end")
    all_ = spans.select("match", "question", "start", "end", F.lit(True).alias("_p"))
    if ignored is not None:
        all_ = all_.unionByName(ignored.select("match", "question", "start", "end", F.lit(False).alias("_p")))
    pairs = near_pairs(w, all_.where("question is not null"), ["match"], ignore_near, cell)
    # dealt out by window once: its questions meet it as one row and part after that
    pairs = pairs.select("match", "wid", "question", F.when(F.col("_p"), _shared()).alias("ov"), F.when(F.col("_p"), gap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("gp"), (~F.col("_p") & (_shared() > 0)).alias("ig")).repartition("match", "wid")
    best = pairs.groupBy("match", "wid", "question").agg(F.max("ov").alias("ov"), F.min("gp").alias("gp"), F.bool_or("ig").alias("ig"))
    near = (F.col("ov") > 0) | (F.col("gp") < ignore_near)
    label = F.when(F.col("ov") >= min_overlap, 1).when(near | F.col("ig"), None).otherwise(0)
    by = best.groupBy("match", "wid").agg(F.map_from_entries(F.collect_list(F.struct("question", F.struct(label.alias("label"))))).alias("_by"))
    met = w.select("match", "wid").join(by.hint("merge"), ["match", "wid"], "left").crossJoin(F.broadcast(questions))  # a handful of questions
    own = F.try_element_at("_by", F.col("question"))
    return met.select("match", "wid", "question", F.when(own.isNull(), 0).otherwise(own["label"]).alias("label"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], anti: bool = False, cell: float | None = None) -> DataFrame:
    """Rows of left (with id) that overlap some row of right by more than nothing, or with anti those that don't."""
    pairs = near_pairs(left, right.select(*keys, "start", "end"), keys, cell=cell)
    hit = pairs.where(_shared() > 0).select("id").distinct()
    return left.join(hit.hint("merge"), "id", "left_anti" if anti else "left_semi")


def block_facts(windows: DataFrame, blocks: DataFrame, least: float = 5.0, cell: float | None = None) -> DataFrame:
    """(match, wid, top, covered) of windows that touch a block: top is (level, block, uncertain) of the block with the highest level
    among those that overlap by `least` or more, the first of equals, null without one; covered is how much of the window lies in
    blocks (overlaps of blocks count twice). blocks: match, block, start, end, level, uncertain; a null level doesn't compete."""
    pairs = near_pairs(windows.select("match", "wid", "start", "end"), blocks, ["match"], cell=cell)
    here = F.when((_shared() >= least) & F.col("level").isNotNull(), F.struct((-F.col("level")).alias("l"), "block", "uncertain"))
    return pairs.groupBy("match", "wid").agg(F.min(here).alias("top"), F.sum(_shared()).alias("covered"))


def block_level(windows: DataFrame, blocks: DataFrame, least: float = 5.0, cell: float | None = None) -> DataFrame:
    """(match, wid, level, uncertain) of the top block of block_facts. Windows without one aren't in the result."""
    met = block_facts(windows, blocks, least, cell).where("top is not null")
    return met.select("match", "wid", (-F.col("top.l")).alias("level"), "top.uncertain")


def coverage(windows: DataFrame, blocks: DataFrame, cell: float | None = None) -> DataFrame:
    """windows with covered: how much of each lies in blocks (overlaps of blocks count twice)."""
    pairs = near_pairs(windows.select("match", "wid", "start", "end"), blocks.select("match", "start", "end"), ["match"], cell=cell)
    inside = pairs.groupBy("match", "wid").agg(F.sum(_shared()).alias("covered"))
    return windows.join(inside.hint("merge"), ["match", "wid"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def asof_period(points: DataFrame, periods: DataFrame, slack: float = 30.0) -> DataFrame:
    """points (match, id, t) with the period that started last by t + slack; the first period if none had."""
    p = periods.select(F.col("match").alias("_m"), "period", "audio_start")
    met = points.join(p, F.col("match") == F.col("_m"), "left")
    begun = F.when(F.col("audio_start") - slack <= F.col("t"), F.struct("audio_start", "period"))
    return met.groupBy("match", "id", "t").agg(F.coalesce(F.max(begun)["period"], F.min_by("period", "period")).alias("period"))
