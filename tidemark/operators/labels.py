"""Spans from events and from a teacher, merged into labels of 1, 0 or null (ignore) for each window and question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import LEVELS, QUESTIONS, SHOOTOUT, LabelConfig
from tidemark.functions.scalar import overlap
from tidemark.operators import intervals
from tidemark.operators.events import big_chance
from tidemark.operators.triggers import dedupe_moments

SPAN = ["match", "question", "start", "end", "uncertain", "note", "origin"]


def audio_time(events: DataFrame, periods: DataFrame) -> DataFrame:
    """events with at: the stream time, null for a period that isn't aligned or a null t."""
    of = periods.select(F.col("match").alias("_m"), F.col("period").alias("_p"), F.col("offset").alias("_o"))
    return events.join(of.hint("merge"), (F.col("match") == F.col("_m")) & (F.col("period") == F.col("_p")), "left").withColumn("at", F.col("_o") + F.col("t")).drop("_m", "_p", "_o")


def event_spans(events: DataFrame, periods: DataFrame, cfg: LabelConfig = LabelConfig()) -> DataFrame:
    """(match, question, start, end, event_type, event_t, xg, outcome, card) of the events that make spans; card_search spans are
    regions in which a card is announced. The shootout and what isn't aligned make none."""
    span = lambda q, r: F.struct(F.lit(q).alias("q"), F.lit(r[0]).alias("a"), F.lit(r[1]).alias("b"))
    kind = F.col("type")
    made = (
        F.when(kind.isin("goal", "own_goal"), span("goal", cfg.goal_span))
        .when((kind == "shot") & big_chance(F.col("xg"), F.col("outcome"), cfg.big_chance_min_xg), span("big_chance", cfg.big_chance_span))
        .when(kind == "card", span("card_search", cfg.card_search))
        .when(kind == "penalty_foul", span("controversy", cfg.penalty_span))
    )
    rows = audio_time(events.where(F.col("period") != SHOOTOUT), periods).where("at is not null").withColumn("s", made).where("s is not null")
    return rows.select("match", F.col("s.q").alias("question"), (F.col("at") + F.col("s.a")).alias("start"), (F.col("at") + F.col("s.b")).alias("end"), kind.alias("event_type"), F.col("at").alias("event_t"), "xg", "outcome", "card")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_spans(event: DataFrame, teacher: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positive, ignored, disagreements). event: match, question, start, end; teacher: the same, uncertain and note.

    Goals: events are positive, every teacher span is ignored. Cards: certain teacher spans inside a region are positive, all
    others ignored, and so is a region without a certain span. The other two: events and certain teacher spans are
    positive, uncertain ones ignored. What one side has and the other lacks is logged."""
    e = event.select("match", "question", "start", "end", F.lit("").alias("note")).withColumn("id", F.xxhash64("match", "question", "start", "end"))
    t = teacher.select("match", "question", "start", "end", F.coalesce("uncertain", F.lit(False)).alias("uncertain"), F.coalesce("note", F.lit("")).alias("note"))
    t = t.withColumn("id", F.xxhash64("match", "question", "start", "end", "uncertain", "note"))
    of = lambda df, *q: df.where(F.col("question").isin(*q))
    cols = ["match", "question", "start", "end"]
    take = lambda df, q=None: df.select("match", (F.lit(q) if q else F.col("question")).alias("question"), "start", "end")
    cell = intervals.cell_for(event, teacher)
    met = lambda a, b, anti=False, keys=("match",): intervals.overlapping(a, b, list(keys), anti, cell)
    log = lambda df, kind: df.select("match", (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), F.when(F.col("question") == "card_search", "card").otherwise(F.col("question")).alias("question"), "start", "end", "note")

    regions, cards = of(e, "card_search"), of(t, "card")
    sure, unsure = cards.where("not uncertain"), cards.where("uncertain")
    inside, outside = met(sure, regions), met(sure, regions, anti=True)
    empty_regions = met(regions, sure, anti=True)
    both = of(t, "big_chance", "controversy")
    positive = _union([take(of(e, "goal", "big_chance", "controversy")), take(inside), take(both.where("not uncertain"))])
    ignored = _union([take(of(t, "goal")), take(unsure), take(outside), take(empty_regions, "card"), take(both.where("uncertain"))])
    disagreements = _union([
        log(met(of(t, "goal"), of(e, "goal"), anti=True), "teacher_goal_without_event"),
        log(met(of(e, "goal"), of(t, "goal"), anti=True), "event_goal_without_teacher"),
        log(outside, "teacher_card_outside_event_region"),
        log(empty_regions, "event_card_not_found_by_teacher"),
        log(met(of(e, "big_chance", "controversy"), both, anti=True, keys=("match", "question")), F.concat(F.lit("event_"), F.col("question"), F.lit("_without_teacher"))),
    ])
    return positive.select(*cols), ignored.select(*cols), disagreements


def ignore_overlay(labels: DataFrame, windows: DataFrame, ignored: DataFrame) -> DataFrame:
    """labels (match, wid, question, label) with 0 turned to null where the window overlaps an ignored span; 1 stays 1."""
    pairs = intervals.near_pairs(windows.select("match", "wid", "start", "end"), ignored, ["match"])
    # by window, so that labels dealt out by window, as project leaves them, stay where they are
    hit = pairs.where(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) > 0).groupBy("match", "wid").agg(F.collect_set("question").alias("_q"))
    met = labels.join(hit.hint("merge"), ["match", "wid"], "left")
    within = F.coalesce(F.array_contains("_q", F.col("question")), F.lit(False))
    return met.select("match", "wid", "question", F.when((F.col("label") == 0) & within, None).otherwise(F.col("label")).alias("label"))


def merge_labels(windows: DataFrame, event: DataFrame, teacher: DataFrame, blocks: DataFrame, levels: DataFrame, cfg: LabelConfig = LabelConfig()) -> tuple[DataFrame, DataFrame]:
    """(labels, disagreements): labels is windows' match, wid with a column for each question and intensity. blocks: match, block,
    start, end; levels: match, block, level, uncertain, one row a block at most. Where blocks don't cover a window, what depends on the teacher can't be
    negative there, so anything but 1 becomes null."""
    spark = windows.sparkSession
    positive, ignored, log = merge_spans(event, teacher)
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    w = windows.select("match", "wid", "start", "end")
    cell = intervals.cell_for(w, blocks, cfg.ignore_near)
    long_ = intervals.project(w, positive, asked, cfg.min_overlap, cfg.ignore_near, ignored, cell)
    wide = long_.groupBy("match", "wid").agg(*[F.max(F.when(F.col("question") == q, F.col("label"))).alias(q) for q in QUESTIONS])
    facts = intervals.block_facts(w, blocks.join(levels.hint("merge"), ["match", "block"], "left"), cfg.block_overlap, cell)
    open_ = F.coalesce("covered", F.lit(0.0)) < F.col("end") - F.col("start") - 1e-6
    known = w.join(facts.hint("merge"), ["match", "wid"], "left").select("match", "wid", F.when(~F.col("top.uncertain"), -F.col("top.l")).alias("intensity"), open_.alias("_open"))
    out = wide.join(known.hint("merge"), ["match", "wid"])
    for q in ("big_chance", "controversy", "card", "intensity"):
        out = out.withColumn(q, F.when(F.col("_open") & (F.coalesce(F.col(q), F.lit(-1)) != 1), None).otherwise(F.col(q)))
    missing = blocks.join(levels.select("match", "block").distinct(), ["match", "block"], "left_anti").groupBy("match").agg(F.count("*").alias("n"))
    blank = missing.select("match", F.lit("teacher_missing_intensity_blocks").alias("kind"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.concat(F.col("n").cast("string"), F.lit(" blocks")).alias("note"))
    return out.drop("_open"), log.unionByName(blank)


def teacher_scores(windows: DataFrame, teacher: DataFrame, blocks: DataFrame, levels: DataFrame, cfg: LabelConfig = LabelConfig()) -> DataFrame:
    """(match, wid, question, score, pred) of the teacher alone: uncertain spans count, nothing is ignored, and intensity is the
    highest level of a block that overlaps enough, or 0."""
    spark = windows.sparkSession
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    got = intervals.project(windows, teacher, asked, cfg.min_overlap, 0.0)
    yes = F.coalesce(F.col("label") == 1, F.lit(False)).cast("int")
    binary = got.select("match", "wid", "question", yes.cast("double").alias("score"), yes.alias("pred"))
    best = intervals.block_level(windows, blocks.join(levels.hint("merge"), ["match", "block"]), cfg.block_overlap)
    level = windows.select("match", "wid").join(best.hint("merge"), ["match", "wid"], "left").select("match", "wid", F.lit("intensity").alias("question"), F.coalesce("level", F.lit(0)).cast("double").alias("score"), F.coalesce("level", F.lit(0)).cast("int").alias("pred"))
    return binary.unionByName(level)


def class_balance(labels: DataFrame, keys: list[str], questions=QUESTIONS) -> DataFrame:
    """(keys, question, bucket, n): pos, neg and ignore of each question, and the levels of intensity where it is a column."""
    have = [q for q in (*questions, "intensity") if q in labels.columns]
    long_ = labels.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).cast("int").alias("y")) for q in have])).alias("x")).select(*keys, "x.*")
    level = F.get(F.array(*[F.lit(v) for v in LEVELS]), F.col("y"))
    bucket = F.when(F.col("y").isNull(), "ignore").when(F.col("question") == "intensity", level).when(F.col("y") == 1, "pos").otherwise("neg")
    return long_.groupBy(*keys, "question", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def truth_events(events: DataFrame, periods: DataFrame, review: DataFrame, gap: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(truth, ignored) of (match, question, t): goals and cards from events, the other two from reviewed moments (match, question,
    t, verdict, unsure), each moment once; moments the reviewer wasn't sure of are ignored."""
    at = audio_time(events.where(F.col("period") != SHOOTOUT), periods)
    own = at.where(F.col("type").isin("goal", "own_goal", "card")).select("match", F.when(F.col("type") == "card", "card").otherwise("goal").alias("question"), F.col("at").alias("t"))
    unsure = F.coalesce(F.col("unsure"), F.lit(False))
    yes = dedupe_moments(review.where(~unsure & (F.col("verdict") == "yes")).select("match", "question", "t"), ["match", "question"], gap)
    return own.unionByName(yes.select("match", "question", "t")), review.where(unsure).select("match", "question", "t")
