"""Calibration and thresholds, for all questions at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import LEVELS, QUESTIONS
from tidemark.functions.scalar import apply_platt, logit, one_hot
from tidemark.operators.metrics import running


def fit_platt(df: DataFrame, key: str, rounds: int = 200, ridge: float = 1e-3) -> dict[str, tuple[float, float]]:
    """{question: (a, b)} of label ~ sigmoid(a logit(prob) + b), by Newton's method. A step needs a few sums for each question,
    which one aggregation over all rows gives; rows never come to the driver. A step that raises the loss is halved. Null
    labels don't count."""
    rows = df.where(F.col("label").isNotNull() & F.col("prob").isNotNull()).select(F.col(key).alias("k"), logit(F.col("prob")).alias("x"), F.col("label").cast("double").alias("y")).persist()
    fits = {r["k"]: np.array([1.0, 0.0]) for r in rows.select("k").distinct().collect()}
    before: dict = {}  # of each question still open: where the last step began, the loss there, and the step
    open_ = set(fits)
    try:
        for _ in range(rounds):
            if not open_:
                break
            at = {i: F.create_map(*[v for k in sorted(open_) for v in (F.lit(k), F.lit(float(fits[k][i])))])[F.col("k")] for i in (0, 1)}
            z = F.least(F.greatest(at[0] * F.col("x") + at[1], F.lit(-30.0)), F.lit(30.0))
            live = rows.where(F.col("k").isin(sorted(open_))).select("k", "x", "y", z.alias("z")).withColumn("s", 1 / (1 + F.exp(-F.col("z")))).withColumn("w", F.col("s") * (1 - F.col("s")))
            off, loss = F.col("s") - F.col("y"), F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z")
            sums = live.groupBy("k").agg(F.sum(off * F.col("x")).alias("gx"), F.sum(off).alias("g"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("w") * F.col("x")).alias("xo"), F.sum("w").alias("o"), F.sum(loss).alias("loss"))
            for r in sums.collect():
                k, now = r["k"], fits[r["k"]]
                total = r["loss"] + ridge / 2 * float(now @ now)
                if k in before and total > before[k][1] * (1 + 1e-12) + 1e-12:
                    start, was, step = before[k]
                    before[k] = (start, was, step / 2)
                    fits[k] = start - step / 2
                else:
                    step = np.linalg.solve(np.array([[r["xx"] + ridge, r["xo"]], [r["xo"], r["o"] + ridge]]), np.array([r["gx"], r["g"]]) + ridge * now)
                    before[k] = (now, total, step)
                    fits[k] = now - step
                if np.abs(before[k][2]).max() < 1e-8:
                    open_.discard(k)
    finally:
        rows.unpersist()
    return {k: (float(v[0]), float(v[1])) for k, v in fits.items()}


def with_platt(df: DataFrame, key: str, fits: dict[str, tuple[float, float]], prob: str = "prob") -> DataFrame:
    """df with prob calibrated by its question's fit; questions without one keep theirs."""
    if not fits:
        return df
    pick = lambda i: F.create_map(*[v for k, ab in fits.items() for v in (F.lit(k), F.lit(ab[i]))])[F.col(key)]
    return df.withColumn(prob, F.when(pick(0).isNotNull(), apply_platt(F.col(prob), pick(0), pick(1))).otherwise(F.col(prob)))


def best_threshold(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, f1): of all probs rounded to 4 places, the one with the best F1 of prob >= threshold, the lowest of
    equals. Candidates take their place among the probs, and one running sum gives the counts for all of them. Rounding is
    half up; F1 is compared after 12 places, so that equal fractions tie."""
    rows = df.where(F.col("label").isNotNull()).groupBy(*keys, F.col("prob").alias("score")).agg(F.sum("label").cast("long").alias("tp"), F.count("*").alias("n"))
    cand = rows.select(*keys, F.round("score", 4).alias("score")).distinct()
    # at one score, rows come before the candidate (seq), as they pass it
    points = rows.withColumn("seq", F.lit(0)).withColumn("th", F.lit(False)).unionByName(cand.select(*keys, "score", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("seq"), F.lit(True).alias("th")))
    ranked = running(running(points, keys, F.col("tp"), "tps"), keys, F.col("n"), "ns").where("th")
    pos = rows.groupBy(*keys).agg(F.sum("tp").alias("pos"))
    f1 = F.when(F.col("ns") + F.col("pos") > 0, 2 * F.col("tps") / (F.col("ns") + F.col("pos"))).otherwise(0.0)
    scored = ranked.join(pos, keys).select(*keys, "score", f1.alias("f1"))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.round("f1", 12)).alias("r"), "score", "f1")).alias("b"))
    return best.select(*keys, F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def calibration_pairs(labels: DataFrame) -> DataFrame:
    """(wid, targets) of rows (wid, one column a question): map from each labelled question to its one-hot targets; windows
    without a label are left out."""
    options = {q: ["false", "true"] for q in QUESTIONS} | {"intensity": [str(i) for i in range(len(LEVELS))]}
    have = [q for q in options if q in labels.columns]
    every = F.create_map(*[v for q in have for v in (F.lit(q), one_hot(F.col(q), options[q]))])
    out = labels.select("wid", F.map_filter(every, lambda _, v: v.isNotNull()).alias("targets"))
    return out.where(F.size("targets") > 0)


def argmax_level(probabilities: Column, levels: int = len(LEVELS)) -> Column:
    """The level with the highest probability, the lowest of equals; probabilities is a map from '0', '1', ... to double."""
    items = F.array(*[F.struct((-probabilities[str(i)]).alias("p"), F.lit(i).alias("i")) for i in range(levels)])
    return F.array_min(items)["i"]


def f1_by_threshold(df: DataFrame, keys: list[str], thresholds: list[int]) -> DataFrame:
    """(keys, th, tp, fp, fn, f1) of count >= th for each threshold; f1 = 2tp / max(1, 2tp + fp + fn). Rows are counted by
    (count, label) first, so the thresholds meet a histogram."""
    hist = df.where(F.col("label").isNotNull()).groupBy(*keys, "count", "label").agg(F.count("*").alias("n"))
    grid = hist.withColumn("th", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    on, y = F.col("count") >= F.col("th"), F.col("label") == 1
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = grid.groupBy(*keys, "th").agg(of(on & y).alias("tp"), of(on & ~y).alias("fp"), of(~on & y).alias("fn"))
    return sums.withColumn("f1", 2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def tune_thresholds(df: DataFrame, keys: list[str], thresholds=(1, 2, 3, 4)) -> DataFrame:
    """(keys, th, f1) of the best threshold, the lowest of equals."""
    scored = f1_by_threshold(df, keys, list(thresholds))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.round("f1", 12)).alias("r"), "th", "f1")).alias("b"))
    return best.select(*keys, "b.th", "b.f1")


def tune_cuts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, accuracy) of the cuts lo in 0..5, hi in lo+1..9 that place (count, label) best; the first of equals."""
    hist = df.where(F.col("label").isNotNull()).groupBy(*keys, "count", "label").agg(F.count("*").alias("n"))
    cuts = [F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo in range(6) for hi in range(lo + 1, 10)]
    grid = hist.withColumn("c", F.explode(F.array(*cuts))).select("*", "c.lo", "c.hi")
    level = F.when(F.col("count") < F.col("lo"), 0).when(F.col("count") < F.col("hi"), 1).otherwise(2)
    sums = grid.groupBy(*keys, "lo", "hi").agg(F.sum(F.when(level == F.col("label"), F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("all"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("ok")).alias("r"), "lo", "hi", "all")).alias("b"))
    return best.select(*keys, "b.lo", "b.hi", (-F.col("b.r") / F.col("b.all")).alias("accuracy"))


def saved_pairs(predictions: DataFrame, labels: DataFrame, questions=QUESTIONS) -> DataFrame:
    """(question, wid, prob, label) of saved predictions (wid, answers) and labels (wid, a column a question) of the same windows, null
    labels left out."""
    each = predictions.select("wid", F.explode("answers").alias("question", "a")).select("wid", "question", F.col("a.noul").alias("prob"))
    have = [q for q in questions if q in labels.columns]
    long_ = labels.select("wid", F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).cast("int").alias("label")) for q in have])).alias("x")).select("wid", "x.*")
    return each.join(long_.where("label is not null"), ["wid", "question"]).select("question", "wid", "prob", "label")


def fit_val(pairs: DataFrame, platt: bool = True) -> DataFrame:
    """(question, a, b, threshold, f1) from pairs (question, prob, label) of the validation split: the Platt fit (1, 0 without one), and
    the best threshold of the calibrated probabilities. A row a question, as model_scores takes them."""
    fits = fit_platt(pairs, "question") if platt else {}
    best = best_threshold(with_platt(pairs, "question", fits), ["question"])
    at = lambda i, other: F.create_map(*[v for k, ab in fits.items() for v in (F.lit(k), F.lit(ab[i]))])[F.col("question")] if fits else F.lit(other)
    return best.select("question", at(0, 1.0).alias("a"), at(1, 0.0).alias("b"), "threshold", "f1")
