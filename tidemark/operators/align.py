"""Fits one clock to another: for each period, the offset from event time to stream time at which anchors lie nearest to cues.

anchors: match, period, anchor (a number within them), kind, t. cues: match, cue, t, where cue names a row of the cue table.
All matches are fitted at once; only the periods of a match follow one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.config import BREAK_BEFORE, CUES, RADIUS_FIRST, RADIUS_LATER, SHOOTOUT
from tidemark.sources.shared import written

KINDS = {"goal": "goal", "own_goal": "goal", "corner": "corner", "shot": "shot", "period_start": "period_start", "period_end": "period_end"}


def cue_table(spark: SparkSession, cues=CUES) -> DataFrame:
    """(cue, kind, place, lag, cap, weight), a handful of rows; place is the order among cues of a kind."""
    told = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{float(v)!r}D"
    rows = ", ".join(f"({told(c)}, {told(k)}, {i}, {told(lag)}, {told(cap)}, {told(w)})" for i, (c, k, _, lag, cap, w) in enumerate(cues))
    # values in the plan, so that no task runs for them
    return spark.sql(f"SELECT cue, kind, place, lag, cap, weight FROM VALUES {rows} AS c(cue, kind, place, lag, cap, weight)")


def anchors_of(events: DataFrame) -> DataFrame:
    """Anchors of match events (match, period, type, t): the kinds that have cues, with a time; a goal's shot counts twice."""
    kinds = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])
    rows = events.select("match", "period", kinds[F.col("type")].alias("kind"), "t").where("kind is not null and t is not null")
    return rows.withColumn("anchor", F.row_number().over(Window.partitionBy("match", "period").orderBy("t", "kind")))


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """points (keys, id, t, ...) with near: the closest target time of the same keys, the earlier of equals, null without any.
    Both sides are sorted together, and each point looks to the last target before it and, the other way round, to that after it."""
    extra = [c for c in points.columns if c not in keys]
    both = points.select(*keys, F.struct(*extra).alias("p"), F.col(t).alias("_t"), F.lit(None).cast("double").alias("_h")).unionByName(
        targets.select(*keys, F.lit(None).cast(points.select(F.struct(*extra).alias("p")).schema["p"].dataType).alias("p"), F.col("t").alias("_t"), F.col("t").alias("_h"))
    )
    w = Window.partitionBy(*keys).orderBy("_t", F.col("_h").isNull())
    lo = F.last("_h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.col("_h").isNull())
    hi = F.last("_h", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_lo", lo).withColumn("_hi", hi).where("p is not null")
    near = F.when(F.col("_hi").isNull() | (F.col("_t") - F.col("_lo") <= F.col("_hi") - F.col("_t")), F.col("_lo")).otherwise(F.col("_hi"))
    return met.select(*keys, "p.*", near.alias("near"))


def best_match(anchors: DataFrame, hits: DataFrame, cues: DataFrame, id_cols: list[str]) -> DataFrame:
    """anchors (match, id_cols, kind, t, offset) with cost and residual of the best cue of their kind: weight times distance, at
    most the cap, and the signed distance or null beyond it. Of equal costs the first cue in the table counts."""
    tried = anchors.join(F.broadcast(cues), "kind")  # the cue table
    tried = tried.withColumn("pred", F.col("offset") + F.col("t") + F.col("lag"))
    met = nearest(tried, hits.select("match", "cue", "t"), ["match", "cue"], "pred")
    d = F.when(F.abs(F.col("near") - F.col("pred")) <= F.col("cap"), F.col("near") - F.col("pred"))
    cost = F.col("weight") * F.coalesce(F.abs(d), F.col("cap"))
    best = met.withColumn("_d", d).groupBy("match", *id_cols, "kind", "t", "offset").agg(F.min(F.struct(cost.alias("cost"), "place", F.col("_d").alias("d"))).alias("b"))
    return best.select("match", *id_cols, "kind", "t", "offset", F.col("b.cost").alias("cost"), F.col("b.d").alias("residual"))


def cost_curve(hits: DataFrame, cues: DataFrame) -> DataFrame:
    """(match, kind, x, cost, slope): what an anchor of a kind costs whose event time plus offset is x: a line from each x to the next,
    and the least weight times cap of the kind's cues before the first x and after the last. It depends on cues alone, so all anchors
    and offsets share it.

    Of one cue the cost is the distance to the nearest hit, up to the cap: lines that bend at hits, at the middle between two, or where
    the cap is reached. Of several it is the least of them, which also bends where two of them cross.
    """
    keys = ["match", "kind", "cue"]
    p = hits.join(F.broadcast(cues), "cue").select(*keys, "cap", "weight", (F.col("t") - F.col("lag")).alias("p"))  # the cue table
    # dealt out once: all that follows is by match and kind, or more; it is work, not bytes, so a number that isn't made smaller
    p = p.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "match", "kind").distinct()
    w = Window.partitionBy(*keys).orderBy("p")
    p = p.withColumn("_next", F.lead("p").over(w)).withColumn("_first", F.lag("p").over(w).isNull())
    cap, top, gap = F.col("cap"), F.col("weight") * F.col("cap"), F.col("_next") - F.col("p")
    knot = lambda x, v: F.struct(x.alias("x"), v.cast("double").alias("v"))
    bends = F.array(
        F.when(F.col("_first"), knot(F.col("p") - cap, top)),
        knot(F.col("p"), F.lit(0.0)),
        F.when(gap.isNull() | (gap > 2 * cap), knot(F.col("p") + cap, top)),
        F.when(gap > 2 * cap, knot(F.col("_next") - cap, top)),
        F.when(gap <= 2 * cap, knot((F.col("p") + F.col("_next")) / 2, F.col("weight") * gap / 2)),
    )
    knots = p.select(*keys, F.explode(F.array_compact(bends)).alias("k")).select(*keys, "k.x", "k.v")
    # every cue of a kind at every bend of the kind: on the line between its own bends around it
    asked = knots.select("match", "kind", "x").distinct().join(F.broadcast(cues.select("kind", "cue")), "kind").select(*keys, "x", F.lit(None).cast("double").alias("v"))
    w = Window.partitionBy(*keys).orderBy("x", F.col("v").isNull())
    back = Window.partitionBy(*keys).orderBy(F.desc("x"), F.col("v").isNull())  # frames to the end are read anew for each row, so the other way round
    own = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
    both = knots.unionByName(asked).withColumn("_a", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(own, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("_b.x") > F.col("_a.x"), (F.col("x") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))).otherwise(0.0)
    at = both.where("v is null").join(F.broadcast(cues.select("cue", (F.col("weight") * F.col("cap")).alias("_top"), "place")), "cue")
    at = at.withColumn("_v", F.when(F.col("_a.x") == F.col("x"), F.col("_a.v")).otherwise(F.coalesce(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * part, F.col("_top"))))
    lines = at.groupBy("match", "kind", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_v"))), lambda c: c["_v"]).alias("vs"))  # a value a cue
    w = Window.partitionBy("match", "kind").orderBy("x")
    lines = lines.withColumn("_x", F.lead("x").over(w)).withColumn("_vs", F.lead("vs").over(w))
    span = F.sequence(F.lit(0), F.size("vs") - 1)
    less = lambda i, j, c: F.get(F.col(c), i) - F.get(F.col(c), j)
    crossed = F.flatten(F.transform(span, lambda i: F.transform(F.filter(span, lambda j: (j > i) & (less(i, j, "vs") * less(i, j, "_vs") < 0)), lambda j: less(i, j, "vs") / (less(i, j, "vs") - less(i, j, "_vs")))))
    there = lambda s: F.array_min(F.zip_with("vs", "_vs", lambda a, b: a + s * (b - a)))
    points = F.concat(F.array(knot(F.col("x"), F.array_min("vs"))), F.coalesce(F.transform(crossed, lambda s: knot(F.col("x") + s * (F.col("_x") - F.col("x")), there(s))), F.array().cast("array<struct<x:double,v:double>>")))
    curve = lines.select("match", "kind", F.explode(points).alias("k")).select("match", "kind", "k.x", F.col("k.v").alias("cost")).groupBy("match", "kind", "x").agg(F.min("cost").alias("cost"))
    return curve.withColumn("slope", F.coalesce((F.lead("cost").over(w) - F.col("cost")) / (F.lead("x").over(w) - F.col("x")), F.lit(0.0)))


def _parts(anchors: DataFrame, hits: DataFrame, cues: DataFrame, search: DataFrame, keys: list[str], step: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """(starts, turns) over the grid of search: cost and slope of each anchor where its grid begins (keys, _lo, _n, _f, _s), and the bends
    inside it as second differences (keys, i, dd)."""
    curve = written(cost_curve(hits, cues), "cost-curve")  # some three rows a hit
    lo, n = F.col("center") - F.col("radius"), F.floor(2 * F.col("radius") / step).cast("int")
    base = anchors.join(search.hint("merge"), ["match", "period"]).select(*dict.fromkeys([*keys, "match", "kind"]), lo.alias("_lo"), n.alias("_n"), (lo + F.col("t")).alias("_x"))
    # cost and slope where the grid begins: on the line of the last bend before
    w = Window.partitionBy("match", "kind")
    bend = F.struct("x", "cost", "slope")
    rows = base.select("*", F.lit(None).cast("struct<x:double,cost:double,slope:double>").alias("_c"), F.col("_x").alias("_at")).unionByName(curve.select("match", "kind", bend.alias("_c"), F.col("x").alias("_at")), allowMissingColumns=True)
    before = F.last("_c", ignorenulls=True).over(w.orderBy("_at", F.col("_c").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    least = cues.groupBy("kind").agg(F.min(F.col("weight") * F.col("cap")).alias("_least"))
    begun = rows.withColumn("_b", before).where("_c is null").join(F.broadcast(least), "kind")
    starts = begun.select(*keys, "_lo", "_n", F.coalesce(F.col("_b.cost") + F.col("_b.slope") * (F.col("_x") - F.col("_b.x")), F.col("_least")).alias("_f"), F.coalesce(F.col("_b.slope"), F.lit(0.0)).alias("_s"))
    # bends inside the grid
    turn = curve.withColumn("_d", F.col("slope") - F.coalesce(F.lag("slope").over(w.orderBy("x")), F.lit(0.0))).where("_d <> 0").select("match", "kind", "x", "_d", F.floor(F.col("x") / cell).alias("_cell"))
    near = base.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_x") / cell), F.floor((F.col("_x") + F.col("_n") * step) / cell))))
    met = near.join(turn.hint("merge"), ["match", "kind", "_cell"]).where("x > _x").withColumn("_u", (F.col("x") - F.col("_x")) / step)
    at = F.floor("_u").cast("int")
    two = F.array(F.struct((at + 1).alias("i"), (F.col("_d") * step * (1 - F.col("_u") + at)).alias("dd")), F.struct((at + 2).alias("i"), (F.col("_d") * step * (F.col("_u") - at)).alias("dd")))
    return starts, met.select(*keys, "_n", F.explode(two).alias("k")).where("k.i <= _n").select(*keys, "k.i", "k.dd")


def _sums(starts: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _lo, _n, _f, _s, _k): a row a key, with its second differences as a list of one a place on the grid at most."""
    by = turns.repartition(*keys).groupBy(*keys, "i").agg(F.sum("dd").alias("dd")).groupBy(*keys).agg(F.collect_list(F.struct("i", "dd")).alias("_k"))
    begun = starts.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.min("_n").alias("_n"), F.sum("_f").alias("_f"), F.sum("_s").alias("_s"))
    return begun.join(by.hint("merge"), keys, "left").withColumn("_k", F.coalesce("_k", F.array().cast("array<struct<i:int,dd:double>>")))


#: So many keys have their grids in memory at once.
_GRIDS = 256


def _curves(batch: pa.RecordBatch, step: float, tail: str = "") -> np.ndarray:
    """Costs of a batch of _sums, a row a key, all with grids as long; tail names another set of columns."""
    f, s = (batch.column(f"{c}{tail}").to_numpy(zero_copy_only=False) for c in ("_f", "_s"))
    k, n = batch.column(f"_k{tail}"), batch.column("_n")[0].as_py()
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(k).to_numpy(zero_copy_only=False))
    flat = k.flatten()
    costs = np.zeros((len(batch), n + 1))
    costs[row, flat.field("i").to_numpy(zero_copy_only=False)] = flat.field("dd").to_numpy(zero_copy_only=False)
    np.cumsum(costs, axis=1, out=costs)
    np.cumsum(costs, axis=1, out=costs)
    costs += f[:, None] + np.arange(n + 1) * step * s[:, None]
    return costs


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of _sums in small ones whose grids are as long."""
    for whole in batches:
        for n in pc.unique(whole.column("_n")):
            own = whole.filter(pc.equal(whole.column("_n"), n))
            for at in range(0, len(own), _GRIDS):
                yield own.slice(at, _GRIDS)


def _spread(keys: list[str], step: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _alike(batches):
            costs = _curves(b, step)
            of = pa.array(np.repeat(np.arange(len(b)), costs.shape[1]))
            offset = b.column("_lo").to_numpy(zero_copy_only=False)[:, None] + np.arange(costs.shape[1]) * step
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(of) for k in keys], pa.array(offset.ravel()), pa.array(costs.ravel())], [*keys, "offset", "cost"])

    return run


def _lowest_on_grid(keys: list[str], step: float, less: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _alike(batches):
            costs = _curves(b, step, "_all") - _curves(b, step) if less else _curves(b, step)
            first = np.argmax(costs <= costs.min(axis=1, keepdims=True) + _CLOSE, axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(b.column("_lo").to_numpy(zero_copy_only=False) + first * step)], [*keys, "_o"])

    return run


def _schema(df: DataFrame, keys: list[str], *more: str) -> StructType:
    return StructType([*[StructField(k, df.schema[k].dataType) for k in keys], *[StructField(c, DoubleType()) for c in more]])


def grid_costs(anchors: DataFrame, hits: DataFrame, cues: DataFrame, search: DataFrame, keys: list[str], step: float = 1.0, cell: float = 600.0) -> DataFrame:
    """(keys, offset, cost) over the grid of search (match, period, center, radius), the costs summed over the anchors of a key: match and
    period, or an anchor of its own.

    Each bend of an anchor's curve is two numbers on the grid, second differences of its costs; summed over anchors, they are added up
    twice along the grid, where a key's row is. So work goes with anchors times bends and with offsets, and no row an offset is shuffled.
    Sums differ from those of best_match in the last places.
    """
    sums = _sums(*_parts(anchors, hits, cues, search, keys, step, cell), keys)
    return sums.mapInArrow(_spread(keys, step), _schema(sums, keys, "offset", "cost"))


#: On a grid, costs that close to the least count as equal to it: sums along it may be off by less.
_CLOSE = 1e-6


def _first_low(sums: DataFrame, keys: list[str], step: float, less: bool = False) -> DataFrame:
    """(keys, _o): the smallest offset whose cost is the least, or as good as, of _sums; with less, whose cost without the key's own is, of
    _sums with those of its period beside them (_f_all, _s_all, _k_all)."""
    return sums.mapInArrow(_lowest_on_grid(keys, step, less), _schema(sums, keys, "_o"))


def _own_costs(anchors: DataFrame, hits: DataFrame, cues: DataFrame, grid: Column) -> DataFrame:
    """Cost of each anchor at each offset of its period's array."""
    spread = anchors.withColumn("offset", F.explode(grid))
    return best_match(spread, hits, cues, ["period", "anchor"]).select("match", "period", "anchor", "offset", "cost")


def _lowest(costs: DataFrame) -> DataFrame:
    """Per period, the offset of least cost, the smallest of equals; costs are compared after 9 places, as sums come in any
    order."""
    sums = costs.groupBy("match", "period", "offset").agg(F.sum("cost").alias("cost"))
    return sums.groupBy("match", "period").agg(F.min(F.struct(F.round("cost", 9).alias("c"), "offset")).alias("b")).select("match", "period", F.col("b.offset").alias("offset"), F.col("b.c").alias("cost"))


def offset_costs(anchors: DataFrame, hits: DataFrame, cues: DataFrame, search: DataFrame, step: float = 1.0) -> DataFrame:
    """(match, period, offset, cost) over the grid of search (match, period, center, radius)."""
    return grid_costs(anchors, hits, cues, search, ["match", "period"], step)


def fit_offset(anchors: DataFrame, hits: DataFrame, cues: DataFrame, search: DataFrame, step: float = 1.0) -> DataFrame:
    """(match, period, offset, cost): the best of a grid, and then of nine places a quarter of a second apart around it."""
    period = ["match", "period"]
    coarse = _first_low(_sums(*_parts(anchors, hits, cues, search, period, step, 600.0), period), period, step)
    fine = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("_o") - step + 0.25 * i)
    return _lowest(_own_costs(anchors.join(coarse, ["match", "period"]), hits, cues, fine))


def loo_residuals(anchors: DataFrame, hits: DataFrame, cues: DataFrame, fitted: DataFrame, radius: float = 120.0, step: float = 1.0) -> DataFrame:
    """(match, period, anchor, kind, t, fit_residual, loo_residual, loo_offset): each anchor against the offset of its period and
    against one fitted without it. A cost is a sum over anchors, so leaving one out is a subtraction, not another fit."""
    of = written(fitted.select("match", "period", F.col("offset").alias("center")), "fitted")
    base = anchors.join(of, ["match", "period"])
    one = ["match", "period", "anchor"]

    starts, turns = _parts(anchors, hits, cues, of.withColumn("radius", F.lit(radius)), one, step, 600.0)
    both = _sums(starts, turns, ["match", "period"]).select("match", "period", *[F.col(c).alias(f"{c}_all") for c in ("_f", "_s", "_k")])
    coarse = _first_low(_sums(starts, turns, one).join(both.hint("merge"), ["match", "period"]), one, step, less=True)
    # in the fine pass every anchor has a grid of its own, at which all anchors of the period are weighed
    fine = written(coarse.select(*one, F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("_o") - step + 0.25 * i)).alias("offset")), "left-out")
    offsets = fine.select("match", "period", "offset").distinct()
    costs = best_match(anchors.join(offsets, ["match", "period"]), hits, cues, ["period", "anchor"]).select(*one, "offset", "cost")
    costs = costs.withColumn("rest", F.round(F.sum("cost").over(Window.partitionBy("match", "period", "offset")) - F.col("cost"), 9))
    best = fine.join(costs, [*one, "offset"]).groupBy(*one).agg(F.min(F.struct("rest", "offset")).alias("b")).select(*one, F.col("b.offset").alias("_o"))
    alone = anchors.groupBy("match", "period").agg((F.count("*") == 1).alias("_alone"))
    loo = best.join(of, ["match", "period"]).join(alone, ["match", "period"]).select(*one, F.when(F.col("_alone"), F.col("center")).otherwise(F.col("_o")).alias("loo_offset"))
    at_fit = best_match(base.withColumn("offset", F.col("center")).drop("center"), hits, cues, ["period", "anchor"])
    at_loo = best_match(anchors.join(loo, ["match", "period", "anchor"]).withColumnRenamed("loo_offset", "offset"), hits, cues, ["period", "anchor"])
    fit = at_fit.select("match", "period", "anchor", "kind", "t", F.round("residual", 2).alias("fit_residual"))
    return fit.join(at_loo.select("match", "period", "anchor", F.round("residual", 2).alias("loo_residual"), F.col("offset").alias("loo_offset")), ["match", "period", "anchor"])


def residual_summary(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, n, found, median_abs, max_abs) of loo_residual; null figures where none was found."""
    r = F.abs("loo_residual")
    return residuals.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.count("loo_residual").alias("found"), F.round(F.percentile(r, F.lit(0.5)), 1).alias("median_abs"), F.round(F.max(r), 1).alias("max_abs"))


def kickoff_hint(registry: DataFrame, metadata: DataFrame) -> DataFrame:
    """(match, hint): seconds from the stream's release to kickoff for streams that were live, else 0."""
    met = registry.join(metadata, "match", "left")
    live = F.when(F.col("live_status") == "was_live", F.col("kickoff").cast("long") - F.col("release_ts"))
    return met.select("match", F.coalesce(live, F.lit(0)).cast("double").alias("hint"))


def align(anchors: DataFrame, hits: DataFrame, cues: DataFrame, ends: DataFrame, hints: DataFrame, radius_first: float = RADIUS_FIRST, radius_later: float = RADIUS_LATER) -> DataFrame:
    """(match, period, offset, audio_start, audio_end, length_s, search_center) of all matches. ends: match, period, t of the
    period's end; hints: match, hint. A period is sought a break after the one before it ended, so periods are fitted in turn,
    each for all matches together; the shootout isn't."""
    periods = sorted(r["period"] for r in ends.where(f"period <> {SHOOTOUT}").select("period").distinct().collect())  # four at most
    done, ended = None, hints.select("match", F.col("hint").alias("_c"), F.lit(radius_first).alias("_r"))
    ended = ends.select("match").distinct().join(ended, "match", "left").select("match", F.coalesce("_c", F.lit(0.0)).alias("_c"), F.coalesce("_r", F.lit(radius_first)).alias("_r"), F.lit(None).cast("double").alias("_end"))
    for p in periods:
        here = ends.where(F.col("period") == p).select("match", "period", F.col("t").alias("length_s"))
        center = F.when(F.col("_end").isNotNull(), F.col("_end") + BREAK_BEFORE.get(p, 300.0)).otherwise(F.col("_c"))
        radius = F.when(F.col("_end").isNotNull(), F.lit(radius_later)).otherwise(F.col("_r"))
        search = here.join(ended, "match").select("match", "period", "length_s", center.alias("center"), radius.alias("radius"))
        found = fit_offset(anchors.where(F.col("period") == p), hits, cues, search.select("match", "period", "center", "radius"))
        row = search.join(found, ["match", "period"]).select("match", "period", "offset", F.col("offset").alias("audio_start"), (F.col("offset") + F.col("length_s")).alias("audio_end"), "length_s", F.col("center").alias("search_center"))
        row = written(row, "align")  # a row a match, used by every later period
        done = row if done is None else done.unionByName(row)
        ended = ended.join(row.select("match", F.col("audio_end").alias("_new")), "match", "left").select("match", "_c", "_r", F.coalesce("_new", "_end").alias("_end"))
    return done
