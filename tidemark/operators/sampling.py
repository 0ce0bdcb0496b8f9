"""Strata, samples with a least distance, and rebalanced training rows. Every draw is by md5, so it is the same on every run and in
every engine, and needs no order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import QUESTIONS
from tidemark.sources.shared import written

TARGETS = {"positive": 60, "keyword": 40, "random": 50}


#: Windows of a stratum that are looked at for each one to be drawn, at first.
POOL = 8


def uniform(*cols, seed: int = 0) -> Column:
    """In [0, 1), from the first 13 hex digits of the md5 of `seed:column:...`, which other engines give too. Nulls are empty."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stratum(questions=QUESTIONS, hits: str = "{}_hits") -> Column:
    """positive if any label is 1, else keyword if any rule hits, else random."""
    any_ = lambda cs: F.coalesce(F.greatest(*cs, F.lit(False)), F.lit(False))
    return F.when(any_([F.col(q) == 1 for q in questions]), "positive").when(any_([F.col(hits.format(q)) > 0 for q in questions]), "keyword").otherwise("random")


def strata_weights(df: DataFrame, keys: list[str], targets: dict[str, int] = TARGETS) -> DataFrame:
    """(keys, stratum, size, n, weight): rows of each stratum, how many are drawn, and what each drawn one stands for."""
    sizes = df.groupBy(*keys, "stratum").agg(F.count("*").alias("size"))
    want = F.create_map(*[F.lit(v) for kv in targets.items() for v in kv])[F.col("stratum")]
    n = F.least(F.col("size"), F.coalesce(want, F.lit(0)).cast("long"))
    return sizes.select(*keys, "stratum", "size", n.alias("n"), F.round(F.col("size") / F.greatest(F.lit(1), n), 3).alias("weight"))


def _apart(start: np.ndarray, gap: float) -> np.ndarray:
    """Which of some starts, in the order of their ranks, a draw by rank takes that skips what is nearer than gap to one taken before.
    By rounds: what has the least rank within the gap is taken, its neighbours leave, and so on with the rest."""
    taken = np.zeros(len(start), bool)
    live = np.argsort(start, kind="stable")  # ranks, by time
    while len(live):
        t = start[live]
        lo, hi = np.searchsorted(t, t - gap, side="right"), np.searchsorted(t, t + gap, side="left")
        least = np.minimum.reduceat(np.append(live, len(start)), np.stack([lo, hi], 1).ravel())[::2]
        here = np.sort(start[live[least == live]])
        taken[live[least == live]] = True
        after = np.searchsorted(here, t - gap, side="right")
        blocked = (after < len(here)) & (here[np.minimum(after, len(here) - 1)] < t + gap)
        live = live[~blocked]
    return taken


def min_gap_sample(windows: DataFrame, targets: dict[str, int] = TARGETS, min_gap: float = 10.0, seed: int = 0, pool: int = POOL) -> DataFrame:
    """(match, wid, start, stratum, weight, stratum_size, idx) of windows (match, wid, start, n_words, stratum): strata in the order
    of targets, windows by hash, none nearer than min_gap to one drawn before it, none without words.

    Whether a window is drawn depends on those of lower rank alone, so each stratum's first `pool` windows by rank for each one asked
    are enough, unless too few of them are far apart; only for such matches is the pool made eight times as large. So a task holds some
    hundreds of windows of a match and not its whole past. min_gap must be above 0.
    """
    live = windows.where((F.col("n_words") > 0) & F.col("stratum").isin(list(targets))).select("match", "wid", "start", "stratum", uniform("match", "wid", seed=seed).alias("drawn"), uniform("match", "wid", seed=seed + 1).alias("shown"))
    sizes = live.groupBy("match", "stratum").agg(F.count("*").alias("size"))
    asked = F.create_map(*[F.lit(v) for kv in targets.items() for v in kv])[F.col("stratum")]
    rank = F.row_number().over(Window.partitionBy("match", "stratum").orderBy("drawn", "wid"))
    kind = live.schema["match"].dataType.simpleString()
    columns = ["match", "wid", "start", "stratum", "weight", "stratum_size", "shown"]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, parts, short = np.zeros(0), [], False
        for name, target in targets.items():
            some = pdf[pdf["stratum"] == name].sort_values("rank")
            # what is drawn already has the lowest ranks, and stays
            first = _apart(np.concatenate([starts, some["start"].to_numpy()]), min_gap)[len(starts) :]
            chosen = some[first].head(target)
            size = int(some["size"].iloc[0]) if len(some) else 0
            short |= len(chosen) < target and len(some) < size
            starts = np.concatenate([starts, chosen["start"].to_numpy()])
            parts.append(chosen.assign(weight=size / max(1, len(chosen)), stratum_size=size))
        got = pd.concat(parts).sort_values(["shown", "wid"])
        if short:
            got = pdf.head(1).assign(weight=None, stratum_size=None)
        return got[columns].assign(idx=range(len(got)), short=short)

    done, left, width = None, live, pool
    while True:
        of = left.withColumn("rank", rank).where(F.col("rank") <= width * max(targets.values())).where(F.col("rank") <= width * asked).join(sizes, ["match", "stratum"])
        got = of.groupBy("match").applyInPandas(draw, f"match {kind}, wid string, start double, stratum string, weight double, stratum_size bigint, shown double, idx bigint, short boolean")
        got = written(got, "min-gap")
        part = got.where("not short").drop("shown", "short").withColumn("weight", F.round("weight", 3))
        done = part if done is None else done.unionByName(part)
        again = got.where("short").select("match")
        if again.isEmpty():
            return done
        left, width = left.join(again, "match", "left_semi"), width * 8


def cap_negatives(long_: DataFrame, ratio: float = 10.0, seed: int = 0) -> DataFrame:
    """long_ (wid, question, label) without nulls, and with negatives kept by chance ratio * positives / negatives of their
    question (at most 1)."""
    counts = long_.groupBy("question").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    chance = F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), ratio * F.greatest(F.col("p"), F.lit(1)) / F.col("n")))
    met = long_.where("label is not null").join(F.broadcast(counts.select("question", chance.alias("_k"))), "question")  # a row a question
    return met.where((F.col("label") != 0) | (uniform("wid", "question", seed=seed) < F.col("_k"))).drop("_k")


def upsample(long_: DataFrame, min_pos: int = 300) -> DataFrame:
    """(wid, question, source_wid): copies of positives, taken in turns, for questions with some positives but fewer than
    min_pos; as many as are missing, named `wid#up<question><i>`."""
    pos = long_.where("label = 1")
    # questions with min_pos or more drop out before anything is sorted, so at most min_pos rows of a question are numbered
    few = pos.groupBy("question").agg(F.count("*").alias("_n")).where(F.col("_n") < min_pos)
    order = Window.partitionBy("question").orderBy("wid")
    rows = pos.join(F.broadcast(few), "question").withColumn("_r", F.row_number().over(order) - 1)
    need = F.lit(min_pos) - F.col("_n")
    each = rows.where(F.col("_r") < need).select("question", F.col("wid").alias("source_wid"), F.explode(F.sequence(F.col("_r"), (need - 1).cast("int"), F.col("_n").cast("int"))).alias("i"))
    return each.select(F.concat(F.col("source_wid").cast("string"), F.lit("#up"), "question", F.col("i").cast("string")).alias("wid"), "question", "source_wid")


def training_cases(long_: DataFrame, texts: DataFrame, rebalance: bool = True, ratio: float = 10.0, min_pos: int = 300, seed: int = 0) -> DataFrame:
    """(wid, text, gold): gold is a map from question to label; one case a window, and with rebalance negatives capped, positives
    upsampled as single-question cases. shuffled() puts them in the order of a hash."""
    kept = cap_negatives(long_.where(F.col("question") != "intensity"), ratio, seed) if rebalance else long_.where("label is not null and question <> 'intensity'")
    kept = kept.select("wid", "question", "label").unionByName(long_.where("question = 'intensity' and label is not null").select("wid", "question", "label"))
    cases = kept.groupBy("wid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", "label")))).alias("gold")).join(texts.select("wid", "text"), "wid")
    if not rebalance:
        return cases.select("wid", "text", "gold")
    copies = upsample(long_.where("question <> 'intensity'"), min_pos).join(texts.select(F.col("wid").alias("source_wid"), "text"), "source_wid")
    more = copies.select("wid", "text", F.create_map("question", F.lit(1)).alias("gold"))
    return cases.select("wid", "text", "gold").unionByName(more)


def shuffled(df: DataFrame, *by: str, seed: int = 0) -> DataFrame:
    """df in the order of a hash, the same on every run: for a sink, as a later shuffle loses it."""
    return df.orderBy(uniform(*by, seed=seed), *by)
