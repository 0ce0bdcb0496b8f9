"""Queries over scores: metrics, calibration, tuning, event-level matching, and highlights from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import apply_platt as platt_of
from tidemark.config import TriggerConfig
from tidemark.operators import calibrate, evaluate, metrics, text, triggers
from tidemark.plans import bindings as b
from tidemark.plans import sql as s
from tidemark.plans.streams import _FOLD, _POS, _positives
from tidemark.sources.shared import written
from tidemark.streaming import paced, replay, scoring
from tidemark.streaming.progress import Progress

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, cols: list[str], places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in cols else c for c in df.columns])


_PRF = """SELECT question, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM
(SELECT question, coalesce(sum({w}) FILTER (score >= 0.5 AND label = 1), 0.0::DOUBLE) AS tp, coalesce(sum({w}) FILTER (score >= 0.5 AND label = 0), 0.0::DOUBLE) AS fp, coalesce(sum({w}) FILTER (score < 0.5 AND label = 1), 0.0::DOUBLE) AS fn FROM vs GROUP BY question))"""


@query(f"WITH {s.VECTORS} {_PRF.format(w='1.0::DOUBLE')}")
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.vector_scores(spark, sf_dir)
    return _rounded(metrics.prf(v, ["question"], (F.col("score") >= 0.5).cast("int"), F.col("label")), ["precision", "recall", "f1"])


@query(f"WITH {s.VECTORS} {_PRF.format(w='weight')}")
def prf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.vector_scores(spark, sf_dir)
    return _rounded(metrics.prf(v, ["question"], (F.col("score") >= 0.5).cast("int"), F.col("label"), F.col("weight")), ["precision", "recall", "f1"])


@query(f"""WITH {s.VECTORS}, k AS (SELECT *, row_number() OVER o AS k, sum(label) OVER (PARTITION BY question ORDER BY score DESC, seq ROWS UNBOUNDED PRECEDING) AS tp FROM vs WINDOW o AS (PARTITION BY question ORDER BY score DESC, seq))
SELECT question, round(CASE WHEN sum(label) > 0 THEN sum(CASE WHEN label = 1 THEN tp / k END) / sum(label) END, 9) AS ap FROM k GROUP BY question""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(b.vector_scores(spark, sf_dir), ["question"]), ["ap"])


@query(f"""WITH {s.VECTORS}, r AS (SELECT *, rank() OVER (PARTITION BY question ORDER BY score) + (count(*) OVER (PARTITION BY question, score) - 1) / 2 AS r FROM vs)
SELECT question, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS auc FROM r GROUP BY question""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(b.vector_scores(spark, sf_dir), ["question"]), ["auc"])


_BINS = """bb AS (SELECT unnest(range(0, 10)) AS bin), rb AS (SELECT question, bin, bin / 10.0::DOUBLE AS lo, (bin + 1) / 10.0::DOUBLE AS hi, count(*) AS n, avg(score) AS mean_prob, avg(label) AS frac_pos FROM {t} JOIN bb ON score >= bin / 10.0::DOUBLE AND (score < (bin + 1) / 10.0::DOUBLE OR (bin = 9 AND score = 1.0)) GROUP BY question, bin)"""


def _probs(spark, sf_dir):
    return b.vector_scores(spark, sf_dir).withColumnRenamed("score", "prob")


@query(f"""WITH {s.VECTORS}, {_BINS.format(t='vs')} SELECT question, bin, lo, hi, n, round(mean_prob, 9) AS mean_prob, round(frac_pos, 9) AS frac_pos FROM rb""")
def ece_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.reliability(_probs(spark, sf_dir), ["question"]), ["mean_prob", "frac_pos"])


@query(f"""WITH {s.VECTORS}, al AS (SELECT question, score, label FROM vs UNION ALL SELECT 'pooled', score, label FROM vs), {_BINS.format(t='al')} SELECT question, round(sum(n * abs(mean_prob - frac_pos)) / sum(n), 9) AS ece FROM rb GROUP BY question""")
def ece_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ece_pooled(_probs(spark, sf_dir), "question"), ["ece"])


@query(f"""WITH {s.VECTORS}, {_BINS.format(t='vs')} SELECT question, bin, n FROM rb WHERE n >= 3""")
def reliability_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(_probs(spark, sf_dir), ["question"]).where("n >= 3").select("question", "bin", "n")


def _levels(spark, sf_dir):
    found = text.rule_hits(b.scored_windows(spark, sf_dir), rules=b.RULES)
    return found.select("match", "doc_id", F.when(F.col("intensity") < 20, 0).when(F.col("intensity") < 60, 1).otherwise(2).alias("pred"), (F.coalesce(F.col("quality"), F.lit(0)) + F.coalesce(F.col("toxic"), F.lit(0))).cast("int").alias("label"))


_LEVELS = s.SCORED + ", " + s.HITS + """, od AS (SELECT match, CASE WHEN intensity < 20 THEN 0 WHEN intensity < 60 THEN 1 ELSE 2 END AS pred, coalesce(quality, 0) + coalesce(toxic, 0) AS label FROM h)"""


@query(f"""WITH {_LEVELS} SELECT match, count(*) AS n, round(avg(CAST(label = pred AS DOUBLE)), 9) AS accuracy, round(avg(abs(label - pred)), 9) AS mae FROM od GROUP BY match""")
def ordinal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ordinal(_levels(spark, sf_dir), ["match"]), ["accuracy", "mae"])


@query(f"""WITH {_LEVELS} SELECT (['calm', 'building', 'peak'])[label + 1] || '->' || (['calm', 'building', 'peak'])[pred + 1] AS cell, count(*) AS n FROM od GROUP BY ALL""")
def ordinal_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_levels(spark, sf_dir), [])


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, (list_sort(list(value)))[CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT)] AS p90, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.latency(b.table(spark, sf_dir, "events"), ["event_type"], "value"), ["p50", "mean"], 6)


# --- calibration and tuning -----------------------------------------------------------------------------------------


@query(f"""WITH {s.VECTORS} SELECT seq, round(1 / (1 + exp(-least(greatest(1.7::DOUBLE * ln(p / (1 - p)) - 0.3::DOUBLE, -30.0), 30.0))), 9) AS prob FROM (SELECT seq, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM vs)""")
def apply_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.vector_scores(spark, sf_dir).select("seq", F.round(platt_of(F.col("score"), F.lit(1.7), F.lit(-0.3)), 9).alias("prob"))


#: Newton's steps on counts of equal (score, label), forty of them.
_NEWTON = """hx AS (SELECT question, ln(p / (1 - p)) AS x, CAST(label AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM (SELECT question, label, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM {t} WHERE label IS NOT NULL) GROUP BY ALL),
nw AS (WITH RECURSIVE st AS (SELECT question, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0 AS i FROM hx GROUP BY question
 UNION ALL SELECT question, a - (gx * oo - g * xo) / (xx * oo - xo * xo), b - (xx * g - xo * gx) / (xx * oo - xo * xo), i + 1 FROM (
  SELECT question, a, b, i, sum(n * (s - y) * x) + 0.001::DOUBLE * a AS gx, sum(n * (s - y)) + 0.001::DOUBLE * b AS g, sum(n * s * (1 - s) * x * x) + 0.001::DOUBLE AS xx, sum(n * s * (1 - s) * x) AS xo, sum(n * s * (1 - s)) + 0.001::DOUBLE AS oo
  FROM (SELECT st.question, a, b, i, x, y, n, 1 / (1 + exp(-least(greatest(a * x + b, -30.0), 30.0))) AS s FROM st JOIN hx ON hx.question = st.question WHERE i < 40) GROUP BY question, a, b, i)) SELECT question, a, b FROM st WHERE i = 40)"""


@query(f"""WITH {s.VECTORS}, {_NEWTON.format(t='vs')} SELECT question, round(a, 6) AS a, round(b, 6) AS b FROM nw""")
def fit_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = calibrate.fit_platt(_probs(spark, sf_dir), "question")
    return spark.createDataFrame([(k, round(a, 6), round(v, 6)) for k, (a, v) in sorted(fits.items())], "question string, a double, b double")


_VAL = """vv AS (SELECT question, score, label FROM vs WHERE seq % 7 <> 0)"""


@query(f"""WITH {s.VECTORS}, {_VAL}, {_NEWTON.format(t='vv')}, vp AS (SELECT vv.question, 1 / (1 + exp(-least(greatest(a * ln(p / (1 - p)) + b, -30.0), 30.0))) AS prob, label FROM (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM vv) vv JOIN nw ON nw.question = vv.question),
th AS (SELECT DISTINCT question, round(prob, 4) AS th FROM vp), c AS (SELECT th.question, th.th, sum(label) FILTER (prob >= th) AS tp, count(*) FILTER (prob >= th) AS pr, sum(label) AS pos FROM th JOIN vp ON vp.question = th.question GROUP BY ALL),
f AS (SELECT question, th, CASE WHEN coalesce(pr, 0) + pos > 0 THEN 2 * coalesce(tp, 0) / (pr + pos) ELSE 0 END AS f1 FROM c)
SELECT f.question, round(a, 6) AS a, round(b, 6) AS b, th AS threshold, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(f1, 12) DESC, th) AS k FROM f) f JOIN nw ON nw.question = f.question WHERE k = 1""")
def fit_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From saved predictions and labels, null for every seventh window, to fits and thresholds."""
    v = b.vector_scores(spark, sf_dir)
    kinds = [F.lit(k) for k in ("0", "1", "2", "3")]
    saved = v.select(F.col("seq").alias("wid"), F.create_map("question", F.struct(F.col("score").alias("noul"))).alias("answers"))
    label = F.when(F.col("seq") % 7 != 0, F.col("label"))
    gold = v.select(F.col("seq").alias("wid"), *[F.when(F.col("question") == k, label).alias(n) for k, n in zip(kinds, "0123", strict=True)])
    pairs = calibrate.saved_pairs(saved, gold, ("0", "1", "2", "3"))
    return _rounded(_rounded(calibrate.fit_val(pairs), ["a", "b"], 6), ["f1"])


@query(f"""WITH {s.VECTORS}, th AS (SELECT DISTINCT question, round(score, 4) AS th FROM vs), c AS (SELECT th.question, th.th, sum(label) FILTER (score >= th) AS tp, count(*) FILTER (score >= th) AS pr, sum(label) AS pos FROM th JOIN vs ON vs.question = th.question GROUP BY ALL),
f AS (SELECT question, th, CASE WHEN coalesce(pr, 0) + pos > 0 THEN 2 * coalesce(tp, 0) / (pr + pos) ELSE 0 END AS f1 FROM c)
SELECT question, th AS threshold, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(f1, 12) DESC, th) AS k FROM f) WHERE k = 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(calibrate.best_threshold(_probs(spark, sf_dir), ["question"]), ["f1"])


_COUNTS = s.SCORED + ", " + s.HITS + """, tc AS (SELECT 'goal' AS question, goal AS c, quality AS label FROM h UNION ALL SELECT 'card', card, toxic FROM h)"""


def _counts(spark, sf_dir):
    h = text.rule_hits(b.scored_windows(spark, sf_dir), rules=b.RULES)
    pairs = F.array(F.struct(F.lit("goal").alias("question"), F.col("goal").alias("count"), F.col("quality").alias("label")), F.struct(F.lit("card").alias("question"), F.col("card").alias("count"), F.col("toxic").alias("label")))
    return h.select(F.explode(pairs).alias("x")).select("x.*")


@query(f"""WITH {_COUNTS}, g AS (SELECT question, th, count(*) FILTER (c >= th AND label = 1) AS tp, count(*) FILTER (c >= th AND label = 0) AS fp, count(*) FILTER (c < th AND label = 1) AS fn FROM tc, (SELECT unnest([1, 2, 3, 4]) AS th) WHERE label IS NOT NULL GROUP BY question, th),
f AS (SELECT question, th, 2 * tp / greatest(1, 2 * tp + fp + fn) AS f1 FROM g) SELECT question, th, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(f1, 12) DESC, th) AS k FROM f) WHERE k = 1""")
def keyword_tune_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(calibrate.tune_thresholds(_counts(spark, sf_dir), ["question"]), ["f1"])


@query(f"""WITH {s.SCORED}, {s.HITS}, x AS (SELECT intensity // 20 AS c, quality + toxic AS label FROM h WHERE quality IS NOT NULL), g AS (SELECT lo, hi, count(*) FILTER ((CASE WHEN c < lo THEN 0 WHEN c < hi THEN 1 ELSE 2 END) = label) AS ok, count(*) AS n
FROM x, (SELECT unnest(range(0, 6)) AS lo), (SELECT unnest(range(1, 10)) AS hi) WHERE hi > lo GROUP BY lo, hi) SELECT lo, hi, round(ok / n, 9) AS accuracy FROM g ORDER BY ok DESC, lo, hi LIMIT 1""")
def ordinal_cut_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.rule_hits(b.scored_windows(spark, sf_dir), rules=b.RULES)
    return _rounded(calibrate.tune_cuts(h.select(F.floor(F.col("intensity") / 20).alias("count"), (F.col("quality") + F.col("toxic")).alias("label")), []), ["accuracy"])


@query("""WITH e AS (SELECT vec_id AS wid, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), p AS (SELECT wid, least(greatest(a * 0.5::DOUBLE + 0.5::DOUBLE, 0.0), 1.0) AS g FROM e),
q AS (SELECT wid, 1 / (1 + exp(-least(greatest(1.5::DOUBLE * ln(h / (1 - h)) + 0.1::DOUBLE, -30.0), 30.0))) AS s FROM (SELECT wid, least(greatest(g, 1e-6), 1 - 1e-6) AS h FROM p))
SELECT wid, 'goal' AS question, round(s, 9) AS score, CAST(s >= 0.4 AS INT) AS pred FROM q UNION ALL SELECT wid, 'card', round(g, 9), CAST(g >= 0.6 AS INT) FROM p
UNION ALL SELECT wid, 'intensity', round(a, 9), CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END FROM e""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved predictions, made from vectors, as scores and decisions."""
    v = b.table(spark, sf_dir, "embeddings")
    x = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    noul = F.least(F.greatest(x[0] * 0.5 + 0.5, F.lit(0.0)), F.lit(1.0))
    probs = F.create_map(*[y for i in range(3) for y in (F.lit(str(i)), x[i])])
    answer = lambda p: F.struct(p.alias("noul"), x[0].alias("score"), probs.alias("probabilities"))
    saved = v.select(F.col("vec_id").alias("wid"), F.create_map(F.lit("goal"), answer(noul), F.lit("card"), answer(noul), F.lit("intensity"), answer(F.lit(None).cast("double"))).alias("answers"))
    return _rounded(evaluate.model_scores(saved, {"goal": 0.4, "card": 0.6}, {"goal": (1.5, 0.1)}), ["score"])


_WM = """SELECT method, question, n, positives, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, round(CASE WHEN wp + wr > 0 THEN 2 * wp * wr / (wp + wr) ELSE 0 END, 9) AS f1_weighted, ap FROM (
SELECT method, question, count(*) AS n, sum(label) AS positives, count(*) FILTER (pred = 1 AND label = 1) / greatest(1, count(*) FILTER (pred = 1)) AS p, count(*) FILTER (pred = 1 AND label = 1) / greatest(1, sum(label)) AS r,
 coalesce(sum(weight) FILTER (pred = 1 AND label = 1), 0) / coalesce(sum(weight) FILTER (pred = 1), 1) AS wp, coalesce(sum(weight) FILTER (pred = 1 AND label = 1), 0) / coalesce(sum(weight) FILTER (label = 1), 1) AS wr,
 round(sum(CASE WHEN label = 1 THEN tp / k END) / sum(label), 9) AS ap FROM km GROUP BY method, question)"""


@query(f"""WITH {s.VECTORS}, mm AS (SELECT m AS method, th, vs.* FROM vs, (VALUES ('loose', 0.45), ('strict', 0.6)) q(m, th)), kk AS (SELECT *, CASE WHEN score >= th THEN 1 ELSE 0 END AS pred FROM mm WHERE sure),
km AS (SELECT *, row_number() OVER (PARTITION BY method, question ORDER BY score DESC, seq) AS k, sum(label) OVER (PARTITION BY method, question ORDER BY score DESC, seq ROWS UNBOUNDED PRECEDING) AS tp FROM kk) {_WM}""")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods on gold windows, raw and weighted, at once."""
    v = b.vector_scores(spark, sf_dir)
    pair = F.explode(F.array(F.struct(F.lit("loose").alias("method"), F.lit(0.45).alias("th")), F.struct(F.lit("strict").alias("method"), F.lit(0.6).alias("th"))))
    scores = v.select(F.col("seq").alias("wid"), "question", "score", pair.alias("m")).select("m.method", "wid", "question", "score", (F.col("score") >= F.col("m.th")).cast("int").alias("pred"))
    gold = v.select(F.col("seq").alias("wid"), "seq", "question", "label", "weight", (~F.col("sure")).alias("unsure"))
    out = evaluate.window_metrics(scores, gold).select("method", "question", "n", "positives", "precision", "recall", "f1", "f1_weighted", "ap")
    return _rounded(out, ["precision", "recall", "f1", "f1_weighted", "ap"])


# --- events ---------------------------------------------------------------------------------------------------------

_TRG = _FOLD.format(pos=_POS, gap=21600, cap=86400) + """, tg AS (SELECT *, row_number() OVER (ORDER BY match, question, start) AS id FROM trg WHERE question = 'purchase'), tr AS (SELECT match, event_id AS e_id, t FROM ev WHERE event_type = 'error'), ir AS (SELECT match, event_id AS e_id, t FROM ev WHERE event_type = 'signup')"""
_MATCH = """SELECT coalesce(e.match, g.match) AS match, coalesce(events, 0) AS events, coalesce(caught, 0) AS caught, coalesce(triggers, 0) AS triggers, coalesce(true_triggers, 0) AS true_triggers,
round(CASE WHEN events > 0 THEN coalesce(caught, 0) / events END, 9) AS recall, round(CASE WHEN triggers > 0 THEN coalesce(true_triggers, 0) / triggers END, 9) AS precision, round(coalesce(minutes, 0), 4) AS minutes
FROM (SELECT match, count(*) AS events FROM tr GROUP BY match) e FULL JOIN (SELECT match, count(*) AS triggers, sum("end" - start) / 60 AS minutes FROM tg GROUP BY match) g ON e.match = g.match
LEFT JOIN (SELECT tg.match, count(DISTINCT e_id) AS caught, count(DISTINCT tg.id) AS true_triggers FROM tg JOIN tr ON tr.match = tg.match AND t >= start - {hi} AND t <= "end" - ({lo}) GROUP BY tg.match) c ON c.match = coalesce(e.match, g.match)"""


def _trig(spark, sf_dir):
    t = triggers.merge_capped(_positives(spark, sf_dir), ["match", "question"], 21600.0, 86400.0).where("question = 'purchase'")
    return t.withColumn("id", F.xxhash64("match", "question", "start"))


def _truth(spark, sf_dir, kind="error"):
    return b.events(spark, sf_dir).where(F.col("event_type") == kind).select("match", F.col("event_id").alias("e_id"), "t")


@query(f"WITH {_TRG} {_MATCH.format(lo=-1800, hi=1800)}")
def event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(triggers.event_match(_trig(spark, sf_dir), _truth(spark, sf_dir), ["match"], -1800.0, 1800.0), ["recall", "precision"]), ["minutes"], 4)


@query(f"WITH {_TRG} {_MATCH.format(lo=-600, hi=7200)}")
def event_match_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(triggers.event_match(_trig(spark, sf_dir), _truth(spark, sf_dir), ["match"], -600.0, 7200.0), ["recall", "precision"]), ["minutes"], 4)


@query(f"""WITH {_TRG} SELECT match, start, "end" FROM tg WHERE EXISTS (SELECT 1 FROM tr WHERE tr.match = tg.match AND t BETWEEN start - 1800 AND "end" + 1800) OR NOT EXISTS (SELECT 1 FROM ir WHERE ir.match = tg.match AND t BETWEEN start - 1800 AND "end" + 1800)""")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.drop_ignored(_trig(spark, sf_dir), _truth(spark, sf_dir), _truth(spark, sf_dir, "signup"), ["match"], -1800.0, 1800.0).select("match", "start", "end")


_SWEEP = """{sc}, {hits}, q AS (SELECT match, th, start, "end", least(1.0, goal / th) AS prob FROM h, (SELECT unnest([5, 20, 60]) AS th) WHERE goal >= th),
pos AS (SELECT match || ':' || th AS match, 'goal' AS question, start, "end", prob FROM q), {fold}, tt AS (SELECT split_part(match, ':', 1) AS m, CAST(split_part(match, ':', 2) AS INT) AS th, start, "end" FROM trg),
te AS (SELECT match AS m, start + 10 AS t FROM sw WHERE toxic = 1), ti AS (SELECT match AS m, start + 10 AS t FROM sw WHERE quality = 0),
kt AS (SELECT tt.*, EXISTS (SELECT 1 FROM te WHERE te.m = tt.m AND t BETWEEN start - 30 AND "end" + 30) AS hit, EXISTS (SELECT 1 FROM ti WHERE ti.m = tt.m AND t BETWEEN start - 30 AND "end" + 30) AS near FROM tt),
cg AS (SELECT th, count(*) AS caught FROM (SELECT DISTINCT th, te.m, t FROM te JOIN tt ON tt.m = te.m AND t BETWEEN start - 30 AND "end" + 30) GROUP BY th)"""


@query(f"""WITH {_SWEEP.format(sc=s.SCORED, hits=s.HITS, fold=_FOLD.format(pos='q0 AS (SELECT 1)', gap=30, cap=120))}
SELECT kt.th, (SELECT count(*) FROM te) AS events, coalesce(any_value(caught), 0) AS caught, count(*) FILTER (hit OR NOT near) AS triggers, count(*) FILTER (hit) AS true_triggers, round(sum("end" - start) / 60, 4) AS minutes FROM kt LEFT JOIN cg ON cg.th = kt.th GROUP BY kt.th""")
def keyword_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule at several thresholds, at the level of events, from one count of hits: toxic documents are the events."""
    w = b.scored_windows(spark, sf_dir)
    h = text.rule_hits(w.select("match", "doc_id", "start", "end", "text"), rules={"goal": b.RULES["goal"]})
    counts = h.select(F.col("doc_id").alias("wid"), F.lit("goal").alias("question"), F.col("goal").alias("count"))
    at = lambda c: w.where(c).select("match", F.lit("goal").alias("question"), (F.col("start") + 10).alias("t"))
    windows = h.select(F.col("doc_id").alias("wid"), "match", "start", "end")
    out = evaluate.keyword_sweep(counts, windows, at("toxic = 1"), at("quality = 0"), [5, 20, 60], TriggerConfig(tolerance={"goal": (-30.0, 30.0)}))
    return out.select("th", "events", "caught", "triggers", "true_triggers", F.round("minutes", 4).alias("minutes"))


_DAYS = TriggerConfig(gap=3600.0, max_len=43200.0, tolerance={"goal": (-1800.0, 1800.0), "card": (-600.0, 7200.0)})
_EM = f"""{s.EVENTS}, {s.DAY_WINDOWS}, sc AS (SELECT m AS method, q AS question, w.match, start, "end", ((w.match * 31 + CAST(split_part(wid, ':', 2) AS BIGINT) * 17 + len(q) * 5 + len(m) * 3) % 100) / 100.0::DOUBLE AS score FROM w, (VALUES ('one'), ('other')) a(m), (VALUES ('goal'), ('card')) c(q)),
pos AS (SELECT match || '|' || method AS match, question, start, "end", score AS prob FROM sc WHERE score >= 0.8), {_FOLD.format(pos='q0 AS (SELECT 1)', gap=3600, cap=43200)},
tt AS (SELECT CAST(split_part(match, '|', 1) AS BIGINT) AS m, split_part(match, '|', 2) AS method, question, start, "end" FROM trg),
te AS (SELECT DISTINCT match AS m, type AS question, t FROM ev WHERE type IN ('goal', 'card')), ti AS (SELECT DISTINCT match AS m, CASE type WHEN 'corner' THEN 'card' ELSE 'goal' END AS question, t FROM ev WHERE type IN ('corner', 'substitution')),
tl AS (SELECT *, CASE question WHEN 'goal' THEN -1800 ELSE -600 END AS lo, CASE question WHEN 'goal' THEN 1800 ELSE 7200 END AS hi FROM tt),
kt AS (SELECT tl.*, EXISTS (SELECT 1 FROM te WHERE te.m = tl.m AND te.question = tl.question AND t BETWEEN start + lo AND "end" + hi) AS good, EXISTS (SELECT 1 FROM ti WHERE ti.m = tl.m AND ti.question = tl.question AND t BETWEEN start + lo AND "end" + hi) AS bad,
 EXISTS (SELECT 1 FROM te WHERE te.m = tl.m AND te.question = tl.question AND t BETWEEN start - hi AND "end" - lo) AS hit FROM tl),
kp AS (SELECT * FROM kt WHERE good OR NOT bad),
cg AS (SELECT method, question, count(*) AS caught FROM (SELECT DISTINCT kp.method, te.question, te.m, t FROM te JOIN kp ON kp.m = te.m AND kp.question = te.question AND t BETWEEN start - hi AND "end" - lo) GROUP BY ALL)"""


@query(f"""WITH {_EM}, nt AS (SELECT question, count(*) AS events FROM te GROUP BY question), mn AS (SELECT method, question, sum("end" - start) / 60 AS minutes FROM tt GROUP BY ALL), ag AS (SELECT method, question, count(*) AS triggers, count(*) FILTER (hit) AS true_triggers FROM kp GROUP BY ALL)
SELECT ag.method, ag.question, events, coalesce(caught, 0) AS caught, triggers, true_triggers, round(coalesce(caught, 0) / events, 9) AS recall, round(true_triggers / triggers, 9) AS precision, round(minutes, 4) AS minutes
FROM ag JOIN nt USING (question) JOIN mn ON mn.method = ag.method AND mn.question = ag.question LEFT JOIN cg ON cg.method = ag.method AND cg.question = ag.question""")
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods against goals and cards, cards with a lopsided tolerance; corners and views are moments to ignore."""
    w = b.day_windows(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(q).alias("question")) for m in ("one", "other") for q in ("goal", "card")])
    each = w.select("match", "wid", F.explode(pairs).alias("p")).select("match", "wid", "p.*")
    k = F.split("wid", ":")[1].cast("long")
    score = ((F.col("match") * 31 + k * 17 + F.length("question") * 5 + F.length("method") * 3) % 100) / F.lit(100.0)
    scores = each.select("method", "wid", "question", score.alias("score"), (score >= 0.8).cast("int").alias("pred"))
    e = b.events(spark, sf_dir)
    truth = e.where("type in ('goal', 'card')").select("match", F.col("type").alias("question"), "t").distinct()
    ignored = e.where("type in ('corner', 'substitution')").select("match", F.when(F.col("type") == "corner", "card").otherwise("goal").alias("question"), "t").distinct()
    return _rounded(_rounded(evaluate.event_metrics(scores, w, truth, ignored, _DAYS), ["recall", "precision"]), ["minutes"], 4)


# --- streaming ------------------------------------------------------------------------------------------------------

_STREAM = f"""{s.SCORED}, {s.HITS}, pos AS (SELECT match, 'goal' AS question, start, "end", least(1.0, goal / 40) AS prob FROM h WHERE least(1.0, goal / 40) >= 0.5), {_FOLD.format(pos='q0 AS (SELECT 1)', gap=30, cap=120)}"""


_RULE, _OVER, _AT = {"goal": b.RULES["goal"]}, {"goal": 40}, {"goal": 0.5}


def _windows(spark, sf_dir):
    return b.scored_windows(spark, sf_dir).select("match", F.col("doc_id").cast("string").alias("wid"), "start", "end", "text")


def _scored(spark, sf_dir):
    return scoring.keyword_scores(_windows(spark, sf_dir), _RULE, _OVER).drop("text")


@query(f"""WITH {_STREAM} SELECT match, question, start, "end", round(prob, 4) AS peak_prob FROM trg""")
def stream_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows replayed as a stream and scored in it by rules, with state for each match and question; the batch fold gives the same
    rows."""
    found = replay.run(_windows(spark, sf_dir), ["goal"], _AT, score=lambda w: scoring.keyword_scores(w, _RULE, _OVER))
    return found.select("match", "question", "start", "end", "peak_prob")


@query(f"""WITH {_STREAM} SELECT match, question, start, "end", round(prob, 4) AS peak_prob FROM trg""")
def stream_saved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream_highlights, with predictions saved before and joined to each batch of the stream."""
    saved = written(_scored(spark, sf_dir).select("wid", "goal"), "saved-scores")
    found = replay.run(_windows(spark, sf_dir).drop("text"), ["goal"], _AT, score=lambda w: scoring.saved_scores(w, saved, ["goal"]))
    return found.select("match", "question", "start", "end", "peak_prob")


@query(f"""WITH {s.SCORED} SELECT count(*) + 1 AS rows, true AS batches, true AS timed, true AS settled FROM sw""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches of a replay reported: all rows, and the one that ends it; several batches, their times, and state that is empty in
    the end but for what waits for that last row."""
    with Progress(spark) as seen:
        replay.run(_windows(spark, sf_dir), ["goal"], _AT, score=lambda w: scoring.keyword_scores(w, _RULE, _OVER), name="stream_progress")
    batches, took = seen.batches().where("query = 'stream_progress'"), seen.latencies().where("query = 'stream_progress'")
    sums = batches.agg(F.sum("rows").alias("rows"), (F.count("*") > 1).alias("batches"), (F.max_by("state_rows", "batch") <= 4).alias("settled"))
    return sums.join(F.broadcast(took.select((F.col("p50") > 0).alias("timed"))), how="cross")  # a row each


@query(f"""WITH {s.SCORED} SELECT match, CAST(doc_id AS VARCHAR) AS wid, start, "end" FROM sw""")
def paced_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, handed out in the order of time at a thousand times their speed."""
    rows = _windows(spark, sf_dir).drop("text")
    top = paced.lay_out(rows, "paced", step=600.0)
    return replay.collected(paced.stream(spark, top, rows, speed=1000.0, step=600.0), top)


@query(f"""WITH {_STREAM}, n AS (SELECT match, count(*) AS n_highlights, round(sum("end" - start), 3) AS seconds FROM trg GROUP BY match), w AS (SELECT match, count(*) AS n_windows, round(max("end"), 3) AS last_t, round(sum(least(1.0, goal / 40)), 6) AS trace_sum FROM h GROUP BY match)
SELECT w.match, coalesce(n_highlights, 0) AS n_highlights, coalesce(seconds, 0.0) AS seconds, n_windows, last_t, trace_sum, 0.5::DOUBLE AS threshold, true AS timed FROM w LEFT JOIN n ON n.match = w.match""")
def stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of each match as the stream left it, read back from its JSON: highlights, trace, thresholds, and latencies, which
    differ from run to run, so only that there are any, and of every window, is compared. The scorer runs in the stream."""
    lines = replay.timeline(_windows(spark, sf_dir), ["goal"], _AT, "goal", score=lambda w: scoring.score(w, lambda: scoring.KeywordScorer(_RULE, _OVER), ["goal"]))
    shape = "highlights array<struct<start:double,end:double>>, trace array<struct<t:double,score:double>>, thresholds map<string,double>, latency_ms struct<n:bigint,p50:double,p90:double>"
    j = lines.select("match", F.from_json("json", shape).alias("j")).select("match", "j.*")
    n = F.size("trace").cast("long")
    return j.select(
        "match", F.coalesce(F.size("highlights"), F.lit(0)).cast("long").alias("n_highlights"), F.round(F.coalesce(F.aggregate("highlights", F.lit(0.0), lambda a, x: a + x["end"] - x["start"]), F.lit(0.0)), 3).alias("seconds"), n.alias("n_windows"),
        F.round(F.array_max(F.transform("trace", lambda x: x["t"])), 3).alias("last_t"), F.round(F.aggregate("trace", F.lit(0.0), lambda a, x: a + x["score"]), 6).alias("trace_sum"), F.col("thresholds")["goal"].alias("threshold"),
        ((F.col("latency_ms.n") == n) & (F.col("latency_ms.p50") > 0) & (F.col("latency_ms.p90") > 0)).alias("timed"),
    )


@query(f"""WITH {s.SCORED}, {s.HITS} SELECT match, start + 20 AS t, least(1.0, goal / 40) AS score FROM h""")
def intensity_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming.highlights import intensity_trace as trace

    return trace(_scored(spark, sf_dir), "goal")
