"""Scores against labels. Ranking metrics need the place of every row among all: rows are counted by coarse cell of the order
first, and only rows of one cell are sorted together, so no task sorts all rows of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LEVELS

#: Cells of the score's range, and of the input order within a score.
SCORE_CELLS, SEQ_CELL = 1000, 50_000


def _cells(df: DataFrame) -> DataFrame:
    """Adds _c and _q, which never fall as (score descending, seq ascending) goes on."""
    return df.withColumn("_c", F.floor(-F.col("score") * SCORE_CELLS).cast("long")).withColumn("_q", F.floor(F.col("seq") / SEQ_CELL).cast("long"))


def running(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """df (keys, score, seq, ...) with the running sum of value in the order of score descending, then seq."""
    cut = _cells(df.withColumn("_v", value))
    # a cell holds one stretch of scores; only within one do ties share a seq cell
    sums = cut.groupBy(*keys, "_c").agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*keys, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = cut.groupBy(*keys, "_c", "score", "_q").agg(F.sum("_v").alias("_m"))
    upto = Window.partitionBy(*keys, "_c").orderBy(F.desc("score"), "_q").rowsBetween(Window.unboundedPreceding, -1)
    second = inner.select(*keys, "_c", "score", "_q", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_second"))
    within = Window.partitionBy(*keys, "_c", "score", "_q").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum("_v").over(within))
    out = local.join(second, [*keys, "_c", "score", "_q"]).join(first, [*keys, "_c"])
    return out.withColumn(name, F.col("_first") + F.col("_second") + F.col("_local")).drop("_v", "_c", "_q", "_local", "_first", "_second")


def prf(df: DataFrame, keys: list[str], pred: Column, label: Column, weight: Column | None = None) -> DataFrame:
    """Per key: tp, fp, fn, precision, recall, f1; 0.0 where there is nothing to divide by. With weight, sums of weights."""
    one = F.lit(1.0) if weight is None else weight
    when = lambda c: F.coalesce(F.sum(F.when(c, one)), F.lit(0.0))
    p, y = pred == 1, label == 1
    sums = df.groupBy(*keys).agg(when(p & y).alias("tp"), when(p & ~y).alias("fp"), when(~p & y).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ap of (score, label, seq), ties in the order of seq; null without positives."""
    ranked = running(running(df, keys, F.lit(1), "k"), keys, F.col("label").cast("long"), "tp")
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("label") == 1, F.col("tp") / F.col("k"))).alias("s"), F.sum("label").alias("n"))
    return sums.select(*keys, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("ap"))


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: auc of (score, label) with tied scores at their mean rank; null if one class is absent. Rows are summed by
    score before they are ranked."""
    tied = df.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count("*").alias("n")).withColumn("seq", F.lit(0))
    ranked = running(tied, keys, F.col("n"), "upto")
    # upto counts from the highest score; ranks count from the lowest
    sums = ranked.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("n").alias("all"), F.sum(F.col("p") * (F.col("upto") - (F.col("n") - 1) / 2)).alias("r"))
    neg = F.col("all") - F.col("pos")
    rank_sum = F.col("pos") * (F.col("all") + 1) - F.col("r")
    auc = (rank_sum - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)
    return sums.select(*keys, F.when((F.col("pos") > 0) & (neg > 0), auc).alias("auc"))


def reliability(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, bin, lo, hi, n, mean_prob, frac_pos) of non-empty bins [b/bins, (b+1)/bins); the last takes 1.0 in. Bins are found
    by comparing with these very doubles, as prob * bins would round at the edges."""
    edges = F.array(*[F.lit(b / bins) for b in range(bins)])
    bin_ = F.when((F.col("prob") >= 0) & (F.col("prob") <= 1), F.size(F.filter(edges, lambda e: e <= F.col("prob"))) - 1)
    binned = df.withColumn("bin", bin_).where(F.col("bin").isNotNull())
    sums = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"), F.avg("label").alias("frac_pos"))
    return sums.select(*keys, "bin", (F.col("bin") / F.lit(float(bins))).alias("lo"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("hi"), "n", "mean_prob", "frac_pos")


def ece(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per key: expected calibration error of (prob, label)."""
    table = reliability(df, keys, bins)
    return table.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("frac_pos"))) / F.sum("n")).alias("ece"))


def ece_pooled(df: DataFrame, key: str, bins: int = 10) -> DataFrame:
    """ece for each value of key, and for all rows together under `pooled`."""
    both = df.select(F.explode(F.array(F.col(key).cast("string"), F.lit("pooled"))).alias(key), "prob", "label")
    return ece(both, [key], bins)


def ordinal(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n, accuracy and mae of (label, pred)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("label") - F.col("pred"))).alias("mae"))


def confusion(df: DataFrame, keys: list[str], levels=LEVELS) -> DataFrame:
    """(keys, cell, n) of the pairs `true->pred` that occur."""
    names = F.array(*[F.lit(x) for x in levels])
    cell = F.concat(F.get(names, F.col("label").cast("int")), F.lit("->"), F.get(names, F.col("pred").cast("int")))
    return df.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"))


def latency(df: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Per key: n, p50 (median), p90 (the value at place int(0.9 n) of the sorted ones; null where that is 0) and mean."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.expr(f"percentile({value}, 0.5)").alias("p50"), F.avg(value).alias("mean"))
    tied = df.select(*keys, (-F.col(value)).alias("score"), F.col(value).alias("_x"))
    counts = tied.groupBy(*keys, "score", "_x").agg(F.count("*").alias("m")).withColumn("seq", F.lit(0))
    at = running(counts, keys, F.col("m"), "upto").join(n.select(*keys, F.floor(F.col("n") * 0.9).alias("_at")), keys)
    p90 = at.where((F.col("upto") >= F.col("_at")) & (F.col("_at") > 0)).groupBy(*keys).agg(F.min("_x").alias("p90"))
    return n.join(p90, keys, "left").select(*keys, "n", "p50", "p90", "mean")
