"""Methods against gold windows and true events: what a report shows, as long tables for all methods and questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TriggerConfig
from tidemark.operators import metrics, triggers
from tidemark.operators.calibrate import argmax_level, with_platt
from tidemark.sources.shared import written


def model_scores(predictions: DataFrame, thresholds: dict[str, float], fits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(wid, question, score, pred) of saved predictions (wid, answers map<question, struct<noul,score,probabilities>>): yes/no
    questions by their threshold, after their Platt fit if there is one; intensity by its most likely level."""
    each = predictions.select("wid", F.explode("answers").alias("question", "a"))
    yes_no = with_platt(each.where(F.col("question").isin(list(thresholds))).select("wid", "question", F.col("a.noul").alias("prob")), "question", fits or {})
    th = F.create_map(*[F.lit(v) for q, t in thresholds.items() for v in (q, float(t))])[F.col("question")]
    level = each.where("question = 'intensity'").select("wid", "question", F.col("a.score").alias("score"), argmax_level(F.col("a.probabilities")).alias("pred"))
    return yes_no.select("wid", "question", F.col("prob").alias("score"), (F.col("prob") >= th).cast("int").alias("pred")).unionByName(level)


def window_metrics(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """(method, question, n, positives, precision, recall, f1, *_weighted, ap) of scores (method, wid, question, score, pred) on gold
    (wid, seq, question, label, weight, unsure); unsure windows and null labels don't count. Scores are needed for all that counts: a
    gold label that a method has no score for is an error, found by counting before anything is measured."""
    keys = ["method", "question"]
    counted = gold.where(~F.coalesce("unsure", F.lit(False)) & F.col("label").isNotNull())
    met = with_all_scores(scores, counted)
    plain = metrics.prf(met, keys, F.col("pred"), F.col("label")).select(*keys, "precision", "recall", "f1")
    weighted = metrics.prf(met, keys, F.col("pred"), F.col("label"), F.col("weight")).select(*keys, *[F.col(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")])
    counts = met.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("positives"))
    return counts.join(plain, keys).join(weighted, keys).join(metrics.average_precision(met, keys), keys)


def event_metrics(scores: DataFrame, windows: DataFrame, truth: DataFrame, ignored: DataFrame, cfg: TriggerConfig = TriggerConfig()) -> DataFrame:
    """(method, question, events, caught, triggers, true_triggers, recall, precision, minutes): positive windows merge into
    triggers, minutes are of all of them, and those that hit nothing but an ignored moment are left out after that. truth
    and ignored: match, question, t. Every question has its own tolerance."""
    keys = ["match", "method", "question"]
    pos = scores.where("pred = 1").select("method", "wid", "question", "score").join(windows.select("wid", "match", "start", "end").hint("merge"), "wid").select(*keys, "start", "end", F.col("score").alias("prob"))
    of = lambda i: F.create_map(*[F.lit(x) for q, r in cfg.tolerance.items() for x in (q, float(r[i]))])[F.col("question")]
    asked = F.col("question").isin(list(cfg.tolerance))
    trig = written(triggers.merge_capped(pos.where(asked), keys, cfg.gap, cfg.max_len).withColumn("id", F.monotonically_increasing_id()), "triggers")
    # true and ignored moments meet the triggers in one pass: within a tolerance, or within it mirrored
    far = max([abs(x) for r in cfg.tolerance.values() for x in r], default=0.0)
    cell = triggers.cell_of(trig, -far, far)
    points = truth.select("match", "question", "t", F.lit(True).alias("_true")).unionByName(ignored.select("match", "question", "t", F.lit(False).alias("_true"))).where(asked)
    points = points.select("match", "question", F.col("t").alias("_t"), "_true", F.floor(F.col("t") / cell).cast("long").alias("_cell"))
    met = triggers.by_cell(trig.select(*keys, "id", "start", "end"), -far, far, cell).join(points.hint("merge"), ["match", "question", "_cell"])
    within = lambda a, b: (F.col("_t") >= F.col("start") + a) & (F.col("_t") <= F.col("end") + b)
    met = met.withColumn("_hit", F.col("_true") & within(-of(1), -of(0))).withColumn("_near", within(of(0), of(1))).where("_hit or _near")
    one = Window.partitionBy("id")
    met = met.withColumn("_good", F.max(F.col("_true") & F.col("_near")).over(one)).withColumn("_bad", F.max(~F.col("_true") & F.col("_near")).over(one))
    each = met.groupBy("id", "method", "question").agg(F.max("_hit").alias("_hit"), F.max(F.col("_bad") & ~F.col("_good")).alias("_out"))
    by = ["method", "question"]
    told = each.groupBy(*by).agg(F.count_if("_out").alias("_outs"), F.count_if(F.col("_hit") & ~F.col("_out")).alias("true_triggers"))
    caught = met.where("_hit and (_good or not _bad)").select(*by, "match", "_t").distinct().groupBy(*by).agg(F.count("*").alias("caught"))
    made = trig.groupBy(*by).agg(F.count("*").alias("_n"), (F.sum(F.col("end") - F.col("start")) / 60).alias("minutes"))
    there = truth.where(asked).groupBy("question").agg(F.count("*").alias("events")).crossJoin(F.broadcast(scores.select("method").distinct()))  # a row a method
    sums = there.join(made, by, "full").join(told, by, "left").join(caught, by, "left").na.fill(0, ["events", "_n", "_outs", "true_triggers", "caught"])
    out = sums.withColumn("triggers", F.col("_n") - F.col("_outs")).where("events > 0 or triggers > 0")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(*by, "events", "caught", "triggers", "true_triggers", share("caught", "events").alias("recall"), share("true_triggers", "triggers").alias("precision"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"))


def keyword_sweep(counts: DataFrame, windows: DataFrame, truth: DataFrame, ignored: DataFrame, thresholds: list[int], cfg: TriggerConfig = TriggerConfig()) -> DataFrame:
    """event_metrics of rule hits (wid, question, count) at each of several thresholds, as th in place of method."""
    each = counts.withColumn("th", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    scores = each.select(F.col("th").cast("string").alias("method"), "wid", "question", F.least(F.lit(1.0), F.col("count") / F.col("th")).alias("score"), (F.col("count") >= F.col("th")).cast("int").alias("pred"))
    return event_metrics(scores, windows, truth, ignored, cfg).select(F.col("method").cast("int").alias("th"), "*").drop("method")


def with_all_scores(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """scores (method, wid, question, ...) joined with gold (wid, question, ...); a method that answers a question at all must have a
    score of every gold label of it."""
    met = scores.join(gold, ["wid", "question"])
    asked = scores.select("method", "question").distinct().join(gold.groupBy("question").agg(F.countDistinct("wid").alias("_n")), "question")
    lost = asked.join(met.select("method", "question", "wid").distinct().groupBy("method", "question").agg(F.count("*").alias("_got")), ["method", "question"], "left").where(F.coalesce("_got", F.lit(0)) < F.col("_n"))
    if not lost.isEmpty():
        raise KeyError("gold labels without a score")
    return met


def with_all_labels(scores: DataFrame, labels: DataFrame, key: str = "wid") -> DataFrame:
    """scores joined with labels; a score whose window has no label row is an error, found by counting before anything is measured."""
    lost = scores.join(labels.select(key).distinct(), key, "left_anti").limit(1).count()
    if lost:
        raise KeyError(f"scores of a {key} without a label row")
    return scores.join(labels, key)
