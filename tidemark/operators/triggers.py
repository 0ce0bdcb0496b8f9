"""Positive windows to triggers, points to moments, and how triggers meet events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIGGERS = "array<struct<start:double,end:double,prob:double,peak:double>>"


def merge_uncapped(positives: DataFrame, keys: list[str], gap: float = 30.0) -> DataFrame:
    """Triggers of positives (keys, start, end, prob): windows at most `gap` after the end of all before them join. Peak is
    the middle of the first window of the highest prob."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "prob")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0)
    islands = positives.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.min_by((F.col("start") + F.col("end")) / 2, F.struct(-F.col("prob"), F.col("start"), F.col("end")))
    return islands.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("prob").alias("prob"), top.alias("peak")).drop("_i")


def _fold(windows: Column, gap: float, max_len: float) -> Column:
    """Triggers of a sorted array of (start, end, prob); what is open is kept beside what is done, so no array is rebuilt to
    change its last element."""

    def opened(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["prob"].alias("prob"), ((x["start"] + x["end"]) / 2).alias("peak"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        joins = cur.isNotNull() & (x["start"] - cur["end"] <= gap) & (x["end"] - cur["start"] <= max_len)
        higher = x["prob"] > cur["prob"]
        grown = F.struct(cur["start"].alias("start"), F.greatest(cur["end"], x["end"]).alias("end"), F.when(higher, x["prob"]).otherwise(cur["prob"]).alias("prob"), F.when(higher, (x["start"] + x["end"]) / 2).otherwise(cur["peak"]).alias("peak"))
        done = F.when(joins | cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))
        return F.struct(done.alias("done"), F.when(joins, grown).otherwise(opened(x)).alias("cur"))

    zero = F.struct(F.array().cast(TRIGGERS).alias("done"), F.lit(None).cast(TRIGGERS[6:-1]).alias("cur"))
    return F.aggregate(windows, zero, step, lambda a: F.concat(a["done"], F.array(a["cur"])))


def merge_capped(positives: DataFrame, keys: list[str], gap: float = 30.0, max_len: float = 120.0) -> DataFrame:
    """As merge_uncapped, but a window that would make its trigger longer than max_len starts another, so triggers may overlap.
    Where one starts depends on where the last one did, so the windows between two gaps are folded in order; gaps longer
    than `gap` part them for certain, which bounds what is folded at once."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "prob")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0)
    islands = positives.select(*keys, "start", "end", "prob").withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = islands.groupBy(*keys, "_i").agg(F.array_sort(F.collect_list(F.struct("start", "end", "prob"))).alias("ws"))
    return lists.select(*keys, F.explode(_fold(F.col("ws"), gap, max_len)).alias("t")).select(*keys, "t.*")


def dedupe_moments(points: DataFrame, keys: list[str], gap: float = 30.0) -> DataFrame:
    """(keys, t, n): points (keys, t) at most `gap` after the one before them are one moment, at their mean."""
    w = Window.partitionBy(*keys).orderBy("t")
    chained = points.withColumn("_new", (F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True))).cast("int"))
    chained = chained.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(*keys, "_i").agg(F.avg("t").alias("t"), F.count("*").alias("n")).drop("_i")


def candidate_pool(points: DataFrame, keys: list[str], gap: float = 30.0) -> DataFrame:
    """(keys, t_first, t_last, t, sources): points (keys, t, source) chained as in dedupe_moments, with who proposed them."""
    w = Window.partitionBy(*keys).orderBy("t", "source")
    chained = points.withColumn("_new", (F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True))).cast("int"))
    chained = chained.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = chained.groupBy(*keys, "_i").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.withColumn("t", (F.col("t_first") + F.col("t_last")) / 2).drop("_i")


def longest_block(captions: DataFrame, keys: list[str], gap: float = 300.0) -> DataFrame:
    """(keys, start, end) of the longest stretch of captions (keys, seq, start, end) without a pause over `gap`, in the order of
    seq; a stretch ends where its latest caption does, also before that. At each caption the stretch so far competes, and
    the first of equals wins. Streams without captions aren't in the result."""
    w = Window.partitionBy(*keys).orderBy("seq")
    chained = captions.withColumn("_new", (F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))).cast("int"))
    chained = chained.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.first("start").over(Window.partitionBy(*keys, "_i").orderBy("seq"))
    tried = chained.withColumn("_s", head)
    best = tried.groupBy(*keys).agg(F.min(F.struct((F.col("_s") - F.col("end")).alias("len"), "seq", F.col("_s").alias("start"), "end")).alias("b"))
    return best.select(*keys, "b.start", "b.end")


def bin_coverage(captions: DataFrame, keys: list[str], start: Column, end: Column, step: float = 60.0) -> DataFrame:
    """(keys, coverage): distinct bins of `step` seconds in [start, end) in which a caption starts, by the number of whole bins
    (so a last bin cut short may take it over 1); 0 if there is no whole bin. start and end are columns, alike for a key."""
    bins = F.floor((end - start) / step)
    hit = F.when((F.col("start") >= start) & (F.col("start") < end), F.floor((F.col("start") - start) / step))
    seen = captions.withColumn("_bins", bins).withColumn("_hit", hit)
    out = seen.groupBy(*keys).agg(F.max("_bins").alias("_b"), F.countDistinct("_hit").alias("_h"))
    return out.select(*keys, F.when(F.col("_b") > 0, F.col("_h") / F.col("_b")).otherwise(0.0).alias("coverage"))


def cell_of(triggers: DataFrame, lo: float, hi: float) -> float:
    """A time cell twice as long as what triggers reach on average, ten minutes at least; so a trigger has one and a half rows."""
    return max(600.0, 2 * ((triggers.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0.0) + hi - lo))


def by_cell(triggers: DataFrame, lo: Column | float, hi: Column | float, cell: float) -> DataFrame:
    """triggers once for each cell of [start - hi, end - lo], as _cell."""
    return triggers.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("start") - hi) / cell).cast("long"), F.floor((F.col("end") - lo) / cell).cast("long"))))


def hits(triggers: DataFrame, events: DataFrame, keys: list[str], lo: float, hi: float, cell: float | None = None) -> DataFrame:
    """Pairs (trigger id, event e_id) where start - hi <= t <= end - lo. triggers: keys, id, start, end; events: keys, e_id, t. Without a
    cell its length is measured (cell_of)."""
    cell = cell or cell_of(triggers, lo, hi)
    a = by_cell(triggers, lo, hi, cell)
    b = events.select(*keys, "e_id", "t", F.floor(F.col("t") / cell).cast("long").alias("_cell"))
    met = a.join(b.hint("merge"), [*keys, "_cell"])  # neither side is bounded
    return met.where((F.col("t") >= F.col("start") - hi) & (F.col("t") <= F.col("end") - lo)).select(*keys, "id", "e_id")


def drop_ignored(triggers: DataFrame, truth: DataFrame, ignored: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Triggers that hit a true event, or no ignored one. The tolerance is mirrored here: start + lo <= t <= end + hi."""
    cell = cell_of(triggers, -hi, -lo)
    good = hits(triggers, truth, keys, -hi, -lo, cell).select("id").distinct().withColumn("_good", F.lit(True))
    bad = hits(triggers, ignored, keys, -hi, -lo, cell).select("id").distinct().withColumn("_bad", F.lit(True))
    met = triggers.join(good.hint("merge"), "id", "left").join(bad.hint("merge"), "id", "left")
    return met.where(F.col("_good").isNotNull() | F.col("_bad").isNull()).drop("_good", "_bad")


def event_match(triggers: DataFrame, events: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Per key: events, caught, triggers, true_triggers, recall and precision (null without events or triggers), minutes."""
    pairs = hits(triggers, events, keys, lo, hi)
    caught = pairs.groupBy(*keys).agg(F.countDistinct("e_id").alias("caught"), F.countDistinct("id").alias("true_triggers"))
    n_t = triggers.groupBy(*keys).agg(F.count("*").alias("triggers"), (F.sum(F.col("end") - F.col("start")) / 60).alias("minutes"))
    n_e = events.groupBy(*keys).agg(F.count("*").alias("events"))
    out = n_e.join(n_t, keys, "full").join(caught, keys, "left")
    out = out.na.fill(0, ["events", "triggers", "caught", "true_triggers"]).na.fill(0.0, ["minutes"])
    return out.select(*keys, "events", "caught", "triggers", "true_triggers", F.when(F.col("events") > 0, F.col("caught") / F.col("events")).alias("recall"), F.when(F.col("triggers") > 0, F.col("true_triggers") / F.col("triggers")).alias("precision"), "minutes")


def clip_plan(highlights: DataFrame, questions: list[str], min_prob: float, pre: float, post: float) -> DataFrame:
    """(match, name, question, start, end) of highlights (match, question, start, end, clock, peak_prob) that get a clip: goals and
    cards always, others from min_prob on; numbered by start within a match."""
    always = F.col("question").isin("goal", "card")
    keep = highlights.where(F.col("question").isin(questions) & (always | (F.col("peak_prob") >= min_prob)))
    n = F.row_number().over(Window.partitionBy("match").orderBy("start", "question")) - 1
    name = F.concat_ws("_", F.format_string("%02d", n), "question", F.replace(F.replace("clock", F.lit(" "), F.lit("_")), F.lit(":"), F.lit("m")))
    return keep.select("match", name.alias("name"), "question", F.greatest(F.lit(0.0), F.col("start") - pre).alias("start"), (F.col("end") + post).alias("end"))
