"""Queries over spans, labels and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import LabelConfig
from tidemark.operators import calibrate, intervals, labels, sampling, text
from tidemark.plans import bindings as b
from tidemark.plans import sql as s
from tidemark.sources import readers, sinks

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- intervals ------------------------------------------------------------------------------------------------------

_Q = "qs AS (SELECT unnest(['goal', 'big_chance', 'controversy']) AS question)"


def _questions(spark):
    return spark.createDataFrame([("goal",), ("big_chance",), ("controversy",)], "question string")


_PROJECT = """ov AS (SELECT w.match, w.wid, sp.question, max(greatest(0.0, least(w."end", sp."end") - greatest(w.start, sp.start))) AS ov, min(greatest(0.0, greatest(w.start, sp.start) - least(w."end", sp."end"))) AS gp
 FROM w JOIN {spans} sp ON sp.match = w.match GROUP BY ALL),
pj AS (SELECT w.match, w.wid, q.question, CASE WHEN ov >= 900 THEN 1 WHEN ov > 0 OR gp < 1800 THEN NULL ELSE 0 END AS label FROM w CROSS JOIN qs q LEFT JOIN ov ON ov.match = w.match AND ov.wid = w.wid AND ov.question = q.question)"""


@query(f"WITH {s.SPANS}, {s.DAY_WINDOWS}, {_Q}, {_PROJECT.format(spans='sp')} SELECT match, wid, question, label FROM pj")
def project_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.project(b.day_windows(spark, sf_dir), b.spans(spark, sf_dir), _questions(spark), 900.0, 1800.0)


_OVER = """SELECT a.match, a.id FROM sp a WHERE a.question = 'goal' AND {no} EXISTS (SELECT 1 FROM sp c WHERE c.match = a.match AND c.question = 'controversy' AND least(a."end", c."end") - greatest(a.start, c.start) > 0)"""


@query(f"WITH {s.SPANS} {_OVER.format(no='')}")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.spans(spark, sf_dir)
    return intervals.overlapping(x.where("question = 'goal'"), x.where("question = 'controversy'"), ["match"]).select("match", "id")


@query(f"WITH {s.SPANS} {_OVER.format(no='NOT')}")
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.spans(spark, sf_dir)
    return intervals.overlapping(x.where("question = 'goal'"), x.where("question = 'controversy'"), ["match"], anti=True).select("match", "id")


def _blocks(spark, sf_dir):
    """Purchases as blocks of three hours; their level is by value."""
    e = b.events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select("match", F.format_string("B%07d", "event_id").alias("block"), F.col("t").alias("start"), (F.col("t") + 10800).alias("end"), (F.col("event_id") % 3).cast("int").alias("level"), (F.col("event_id") % 5 == 0).alias("uncertain"))


_BLOCKS = """bl AS (SELECT match, printf('B%07d', event_id) AS block, t AS start, t + 10800 AS "end", CAST(event_id % 3 AS INT) AS level, event_id % 5 = 0 AS uncertain FROM ev WHERE event_type = 'purchase')"""
_LEVEL = """lv AS (SELECT match, wid, level, uncertain FROM (SELECT w.match, w.wid, level, uncertain, row_number() OVER (PARTITION BY w.match, w.wid ORDER BY level DESC, block) AS k FROM w JOIN bl ON bl.match = w.match AND least(w."end", bl."end") - greatest(w.start, bl.start) >= 3600) WHERE k = 1)"""
_COVERED = """cv AS (SELECT w.match, w.wid, w.start, w."end", coalesce(sum(greatest(0.0, least(w."end", bl."end") - greatest(w.start, bl.start))), 0.0) AS covered FROM w LEFT JOIN bl ON bl.match = w.match GROUP BY ALL)"""


@query(f"WITH {s.EVENTS}, {s.DAY_WINDOWS}, {_BLOCKS}, {_LEVEL} SELECT * FROM lv")
def block_max_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.block_level(b.day_windows(spark, sf_dir), _blocks(spark, sf_dir), 3600.0)


@query(f"WITH {s.EVENTS}, {s.DAY_WINDOWS}, {_BLOCKS}, {_COVERED} SELECT match, wid, round(covered, 4) AS covered FROM cv")
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coverage(b.day_windows(spark, sf_dir), _blocks(spark, sf_dir)).select("match", "wid", F.round("covered", 4).alias("covered"))


@query(f"""WITH {s.EVENTS}, p AS (SELECT match, k AS period, k * 600000.0::DOUBLE + 100000 AS audio_start FROM (SELECT DISTINCT match FROM ev), (SELECT unnest(range(1, 5)) AS k))
SELECT e.match, e.event_id AS id, coalesce(arg_max(period, audio_start) FILTER (audio_start - 30 <= t), min(period)) AS period FROM ev e JOIN p ON p.match = e.match GROUP BY e.match, e.event_id""")
def asof_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    p = e.select("match").distinct().select("match", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("period")).withColumn("audio_start", F.col("period") * 600000.0 + 100000)
    return intervals.asof_period(e.select("match", F.col("event_id").alias("id"), "t"), p).select("match", "id", "period")


# --- labels ---------------------------------------------------------------------------------------------------------


def _match_events(spark, sf_dir):
    """Events with the fields that spans need: period by day, time within it, outcomes and cards by number."""
    e = b.events(spark, sf_dir)
    k = F.col("event_id")
    kind = F.when(k % 13 == 0, "penalty_foul").otherwise(F.col("type"))
    return e.select("match", (1 + F.floor(F.col("t") / 518400)).cast("int").alias("period"), (F.col("t") % 518400).alias("t"), kind.alias("type"), "xg", F.when(k % 7 == 0, "Goal").when(k % 7 == 1, "Post").otherwise("Saved").alias("outcome"), F.lit("Yellow Card").alias("card"))


def _day_periods(spark, sf_dir):
    e = b.events(spark, sf_dir).select("match").distinct()
    return e.select("match", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("period")).withColumn("offset", (F.col("period") - 1) * 518400.0 + 60)


_CFG = LabelConfig(goal_span=(-300.0, 1200.0), big_chance_span=(-300.0, 800.0), card_search=(0.0, 12000.0), penalty_span=(-300.0, 3000.0), min_overlap=900.0, ignore_near=1800.0, block_overlap=3600.0)
_SPANS = """me AS (SELECT match, 1 + CAST(floor(t / 518400) AS INT) AS period, t % 518400 AS t, CASE WHEN event_id % 13 = 0 THEN 'penalty_foul' ELSE type END AS type, xg, CASE WHEN event_id % 7 = 0 THEN 'Goal' WHEN event_id % 7 = 1 THEN 'Post' ELSE 'Saved' END AS outcome FROM ev),
au AS (SELECT *, (period - 1) * 518400.0::DOUBLE + 60 + t AS a FROM me WHERE period BETWEEN 1 AND 4),
es AS (SELECT match, 'goal' AS question, a - 300 AS start, a + 1200 AS "end", type AS event_type, a AS event_t FROM au WHERE type IN ('goal', 'own_goal')
 UNION ALL SELECT match, 'big_chance', a - 300, a + 800, type, a FROM au WHERE type = 'shot' AND outcome <> 'Goal' AND (xg >= 0.3 OR outcome IN ('Post', 'Saved to Post'))
 UNION ALL SELECT match, 'card_search', a, a + 12000, type, a FROM au WHERE type = 'card'
 UNION ALL SELECT match, 'controversy', a - 300, a + 3000, type, a FROM au WHERE type = 'penalty_foul')"""


@query(f"""WITH {s.EVENTS}, {_SPANS} SELECT match, question, round(start, 4) AS start, round("end", 4) AS "end", event_type, round(event_t, 4) AS event_t FROM es""")
def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.event_spans(_match_events(spark, sf_dir), _day_periods(spark, sf_dir), _CFG)
    return found.select("match", "question", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "event_type", F.round("event_t", 4).alias("event_t"))


def _teacher(spark, sf_dir):
    """Orders as a teacher's spans: their customer's stream, an hour or two from their date; kinds by number."""
    o = b.table(spark, sf_dir, "orders")
    users = b.table(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("n"))
    k = F.col("o_orderkey")
    q = F.element_at(F.array(*[F.lit(x) for x in ("goal", "card", "big_chance", "controversy")]), (k % 4 + 1).cast("int"))
    start = ((k * 7919) % 2592000).cast("double")
    return o.crossJoin(F.broadcast(users)).select((F.col("o_custkey") % F.col("n")).alias("match"), q.alias("question"), start.alias("start"), (start + 3600 + (k % 3600)).alias("end"), (k % 5 == 0).alias("uncertain"), k.cast("string").alias("note"))


_TEACHER = """te AS (SELECT o_custkey % (SELECT max(user_id) + 1 FROM events) AS match, (['goal', 'card', 'big_chance', 'controversy'])[o_orderkey % 4 + 1] AS question, CAST((o_orderkey * 7919) % 2592000 AS DOUBLE) AS start,
 CAST((o_orderkey * 7919) % 2592000 AS DOUBLE) + 3600 + (o_orderkey % 3600) AS "end", o_orderkey % 5 = 0 AS uncertain, CAST(o_orderkey AS VARCHAR) AS note FROM orders)"""
_EX = """EXISTS (SELECT 1 FROM {b} y WHERE y.match = x.match AND {c} AND least(x."end", y."end") - greatest(x.start, y.start) > 0)"""
_MERGE = f"""po AS (SELECT match, question, start, "end" FROM es WHERE question <> 'card_search' UNION ALL SELECT match, question, start, "end" FROM te x WHERE question = 'card' AND NOT uncertain AND {_EX.format(b='es', c="y.question = 'card_search'")}
 UNION ALL SELECT match, question, start, "end" FROM te WHERE question IN ('big_chance', 'controversy') AND NOT uncertain),
ig AS (SELECT match, question, start, "end" FROM te WHERE question = 'goal' OR uncertain UNION ALL SELECT match, 'card', start, "end" FROM te x WHERE question = 'card' AND NOT uncertain AND NOT {_EX.format(b='es', c="y.question = 'card_search'")}
 UNION ALL SELECT match, 'card', start, "end" FROM es x WHERE question = 'card_search' AND NOT {_EX.format(b='te', c="y.question = 'card' AND NOT y.uncertain")}),
di AS (SELECT match, 'teacher_goal_without_event' AS kind, question, start, "end" FROM te x WHERE question = 'goal' AND NOT {_EX.format(b='es', c="y.question = 'goal'")}
 UNION ALL SELECT match, 'event_goal_without_teacher', question, start, "end" FROM es x WHERE question = 'goal' AND NOT {_EX.format(b='te', c="y.question = 'goal'")}
 UNION ALL SELECT match, 'teacher_card_outside_event_region', question, start, "end" FROM te x WHERE question = 'card' AND NOT uncertain AND NOT {_EX.format(b='es', c="y.question = 'card_search'")}
 UNION ALL SELECT match, 'event_card_not_found_by_teacher', 'card', start, "end" FROM es x WHERE question = 'card_search' AND NOT {_EX.format(b='te', c="y.question = 'card' AND NOT y.uncertain")}
 UNION ALL SELECT match, 'event_' || question || '_without_teacher', question, start, "end" FROM es x WHERE question IN ('big_chance', 'controversy') AND NOT {_EX.format(b='te', c="y.question = x.question")})"""


def _merged(spark, sf_dir):
    return labels.merge_spans(labels.event_spans(_match_events(spark, sf_dir), _day_periods(spark, sf_dir), _CFG), _teacher(spark, sf_dir))


@query(f"""WITH {s.EVENTS}, {_SPANS}, {_TEACHER}, {_MERGE} SELECT match, question, round(start, 4) AS start, round("end", 4) AS "end" FROM po WHERE question <> 'card'""")
def label_merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].where("question <> 'card'").select("match", "question", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(f"""WITH {s.EVENTS}, {_SPANS}, {_TEACHER}, {_MERGE} SELECT match, 'pos' AS side, round(start, 4) AS start, round("end", 4) AS "end" FROM po WHERE question = 'card' UNION ALL SELECT match, 'ignore', round(start, 4), round("end", 4) FROM ig WHERE question = 'card'""")
def label_merge_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, ign, _ = _merged(spark, sf_dir)
    both = pos.withColumn("side", F.lit("pos")).unionByName(ign.withColumn("side", F.lit("ignore"))).where("question = 'card'")
    return both.select("match", "side", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(f"""WITH {s.EVENTS}, {_SPANS}, {_TEACHER}, {_MERGE} SELECT match, kind, question, round(start, 4) AS start, round("end", 4) AS "end" FROM di""")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[2].select("match", "kind", "question", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(f"""WITH {s.EVENTS}, {_SPANS}, {_TEACHER}, {_MERGE} SELECT kind, count(*) AS n FROM di GROUP BY kind""")
def disagreement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[2].groupBy("kind").agg(F.count("*").alias("n"))


_Q4 = "qs AS (SELECT unnest(['goal', 'big_chance', 'controversy', 'card']) AS question)"
_FINAL = f"""{s.EVENTS}, {_SPANS}, {_TEACHER}, {_MERGE}, {s.DAY_WINDOWS}, {_Q4}, {_BLOCKS}, {_LEVEL}, {_COVERED}, {_PROJECT.format(spans='po')},
ih AS (SELECT DISTINCT w.match, w.wid, ig.question FROM w JOIN ig ON ig.match = w.match AND least(w."end", ig."end") - greatest(w.start, ig.start) > 0),
fl AS (SELECT pj.match, pj.wid, pj.question, CASE WHEN label = 0 AND ih.wid IS NOT NULL THEN NULL ELSE label END AS label FROM pj LEFT JOIN ih ON ih.match = pj.match AND ih.wid = pj.wid AND ih.question = pj.question),
wl AS (SELECT match, wid, max(label) FILTER (question = 'goal') AS goal, max(label) FILTER (question = 'big_chance') AS big_chance, max(label) FILTER (question = 'controversy') AS controversy, max(label) FILTER (question = 'card') AS card FROM fl GROUP BY match, wid),
ml AS (SELECT wl.match, wl.wid, goal, CASE WHEN big_chance = 1 OR NOT op THEN big_chance END AS big_chance, CASE WHEN controversy = 1 OR NOT op THEN controversy END AS controversy, CASE WHEN card = 1 OR NOT op THEN card END AS card,
 CASE WHEN (NOT uncertain AND level = 1) OR NOT op THEN (CASE WHEN NOT uncertain THEN level END) END AS intensity
 FROM wl LEFT JOIN lv ON lv.match = wl.match AND lv.wid = wl.wid JOIN (SELECT match, wid, covered < "end" - start - 1e-6 AS op FROM cv) c ON c.match = wl.match AND c.wid = wl.wid)"""


@query(f"WITH {_FINAL} SELECT match, wid, question, label FROM fl")
def ignore_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, ign, _ = _merged(spark, sf_dir)
    w = b.day_windows(spark, sf_dir)
    asked = spark.createDataFrame([(q,) for q in ("goal", "big_chance", "controversy", "card")], "question string")
    return labels.ignore_overlay(intervals.project(w, pos, asked, 900.0, 1800.0), w, ign)


def _labels(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return labels.merge_labels(b.day_windows(spark, sf_dir), labels.event_spans(_match_events(spark, sf_dir), _day_periods(spark, sf_dir), _CFG), _teacher(spark, sf_dir), blocks.select("match", "block", "start", "end"), blocks.select("match", "block", "level", "uncertain"), _CFG)[0]


@query(f"WITH {_FINAL} SELECT match, wid, goal, big_chance, controversy, card, intensity FROM ml")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("match", "wid", "goal", "big_chance", "controversy", "card", "intensity")


@query(f"""WITH {_FINAL}, lg AS (SELECT unnest(['goal', 'big_chance', 'controversy', 'card', 'intensity']) AS question, unnest([goal, big_chance, controversy, card, intensity]) AS y FROM ml)
SELECT question, CASE WHEN y IS NULL THEN 'ignore' WHEN question = 'intensity' THEN (['calm', 'building', 'peak'])[y + 1] WHEN y = 1 THEN 'pos' ELSE 'neg' END AS bucket, count(*) AS n FROM lg GROUP BY ALL""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_balance(_labels(spark, sf_dir), [])


@query(f"""WITH {s.EVENTS}, {_TEACHER}, {s.DAY_WINDOWS}, {_Q4}, {_BLOCKS}, {_LEVEL}, ov AS (SELECT w.match, w.wid, te.question, max(least(w."end", te."end") - greatest(w.start, te.start)) AS ov FROM w JOIN te ON te.match = w.match GROUP BY ALL)
SELECT w.match, w.wid, q.question, CASE WHEN ov >= 900 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN ov >= 900 THEN 1 ELSE 0 END AS pred FROM w CROSS JOIN qs q LEFT JOIN ov ON ov.match = w.match AND ov.wid = w.wid AND ov.question = q.question
UNION ALL SELECT w.match, w.wid, 'intensity', CAST(coalesce(level, 0) AS DOUBLE), coalesce(level, 0) FROM w LEFT JOIN lv ON lv.match = w.match AND lv.wid = w.wid""")
def teacher_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return labels.teacher_scores(b.day_windows(spark, sf_dir), _teacher(spark, sf_dir), blocks.select("match", "block", "start", "end"), blocks.select("match", "block", "level", "uncertain"), _CFG)


_REVIEW = """rv AS (SELECT o_custkey % (SELECT max(user_id) + 1 FROM events) AS match, CASE WHEN o_orderkey % 2 = 0 THEN 'big_chance' ELSE 'controversy' END AS question, CAST((o_orderkey * 7919) % 2592000 AS DOUBLE) AS t, o_orderkey % 3 > 0 AS yes, o_orderkey % 5 = 0 AS unsure FROM orders)"""


@query(f"""WITH {s.EVENTS}, {_SPANS}, {_REVIEW}, x AS (SELECT match, question, t, coalesce(t - lag(t) OVER (PARTITION BY match, question ORDER BY t) > 43200, true) AS new FROM rv WHERE yes AND NOT unsure),
y AS (SELECT match, question, t, sum(CAST(new AS INT)) OVER (PARTITION BY match, question ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM x)
SELECT match, question, round(t, 4) AS t, false AS is_ignore FROM (SELECT match, CASE type WHEN 'card' THEN 'card' ELSE 'goal' END AS question, a AS t FROM au WHERE type IN ('goal', 'own_goal', 'card') UNION ALL SELECT match, question, avg(t) FROM y GROUP BY match, question, i)
UNION ALL SELECT match, question, round(t, 4), true FROM rv WHERE unsure""")
def truth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals and cards of the events, and reviewed moments of the other two, half a day apart."""
    t = _teacher(spark, sf_dir).withColumn("k", F.col("note").cast("long"))
    review = t.select("match", F.when(F.col("k") % 2 == 0, "big_chance").otherwise("controversy").alias("question"), F.col("start").alias("t"), F.when(F.col("k") % 3 > 0, "yes").otherwise("no").alias("verdict"), (F.col("k") % 5 == 0).alias("unsure"))
    truth, ignored = labels.truth_events(_match_events(spark, sf_dir), _day_periods(spark, sf_dir), review, 43200.0)
    both = truth.withColumn("is_ignore", F.lit(False)).unionByName(ignored.withColumn("is_ignore", F.lit(True)))
    return both.select("match", "question", F.round("t", 4).alias("t"), "is_ignore")


# --- samples --------------------------------------------------------------------------------------------------------


def _strata(spark, sf_dir):
    found = text.rule_hits(b.scored_windows(spark, sf_dir), rules={"goal_hits": r"\bder\b", "card_hits": r"\bthe\b"})
    return found.withColumn("goal", F.col("quality")).withColumn("card", F.col("toxic")).withColumn("stratum", sampling.stratum(("goal", "card")))


_STRATA = s.SCORED + r""", st AS (SELECT *, CASE WHEN coalesce(quality, 0) = 1 OR coalesce(toxic, 0) = 1 THEN 'positive' WHEN len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_\p{M}]+'), lambda x: x IN ('the', 'der'))) > 0 THEN 'keyword' ELSE 'random' END AS stratum FROM sw)"""


@query(f"""WITH {_STRATA}, z AS (SELECT match, stratum, count(*) AS size, least(count(*), CASE stratum WHEN 'positive' THEN 60 WHEN 'keyword' THEN 40 ELSE 50 END) AS n FROM st GROUP BY match, stratum)
SELECT match, stratum, size, n, round(size / greatest(1, n), 3) AS weight FROM z""")
def strata_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strata_weights(_strata(spark, sf_dir), ["match"])


def _uniform(seed: int, *cols: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {" || ':' || ".join(cols)}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


# the draw as a fold over a match's windows, stratum after stratum and by hash: what is drawn, and how many of each stratum
@query(f"""WITH {_STRATA}, pl AS (SELECT match, CAST(doc_id AS VARCHAR) AS wid, start, stratum, CASE stratum WHEN 'positive' THEN 1 WHEN 'keyword' THEN 2 ELSE 3 END AS o, {_uniform(0, 'match', 'doc_id')} AS drawn, {_uniform(1, 'match', 'doc_id')} AS shown FROM st),
ls AS (SELECT match, list({{'w': wid, 's': start, 'o': o}} ORDER BY o, drawn, wid) AS l FROM pl GROUP BY match),
fo AS (SELECT match, list_reduce(l, lambda a, x: CASE WHEN a.n[x.o] >= CASE x.o WHEN 1 THEN 60 WHEN 2 THEN 40 ELSE 50 END OR len(list_filter(a.t, lambda y: abs(y - x.s) < 10)) > 0 THEN a
  ELSE {{'t': list_append(a.t, x.s), 'w': list_append(a.w, x.w), 'n': [a.n[1] + CASE x.o WHEN 1 THEN 1 ELSE 0 END, a.n[2] + CASE x.o WHEN 2 THEN 1 ELSE 0 END, a.n[3] + CASE x.o WHEN 3 THEN 1 ELSE 0 END]}} END, {{'t': []::DOUBLE[], 'w': []::VARCHAR[], 'n': [0, 0, 0]}}) AS a FROM ls),
dr AS (SELECT match, unnest(a.w) AS wid FROM fo), sz AS (SELECT match, stratum, count(*) AS size FROM pl GROUP BY ALL), nn AS (SELECT match, stratum, count(*) AS n FROM dr JOIN pl USING (match, wid) GROUP BY ALL)
SELECT match, wid, start, stratum, round(size / n, 3) AS weight, size AS stratum_size, row_number() OVER (PARTITION BY match ORDER BY shown, wid) - 1 AS idx FROM dr JOIN pl USING (match, wid) JOIN sz USING (match, stratum) JOIN nn USING (match, stratum)""")
def min_gap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows drawn of each source, 10 s apart, with what each stands for and the order in which they are shown."""
    w = _strata(spark, sf_dir).select("match", F.col("doc_id").cast("string").alias("wid"), "start", F.lit(1).alias("n_words"), "stratum")
    return sampling.min_gap_sample(w, min_gap=10.0)


def _long(spark, sf_dir):
    d = b.scored_windows(spark, sf_dir)
    pairs = F.array(F.struct(F.lit("goal").alias("question"), F.col("quality").cast("int").alias("label")), F.struct(F.lit("card").alias("question"), F.col("toxic").cast("int").alias("label")))
    return d.select(F.col("doc_id").alias("wid"), F.explode(pairs).alias("x")).select("wid", "x.*")


@query(f"""WITH {s.SCORED}, lg AS (SELECT doc_id AS wid, 'goal' AS question, quality AS label FROM sw WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'card', toxic FROM sw WHERE toxic IS NOT NULL),
ch AS (SELECT question, CASE WHEN count(*) FILTER (label = 0) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0::DOUBLE * greatest(count(*) FILTER (label = 1), 1) / count(*) FILTER (label = 0)) END AS k FROM lg GROUP BY question)
SELECT wid, question, label FROM lg JOIN ch USING (question) WHERE label <> 0 OR {_uniform(0, 'wid', 'question')} < k""")
def neg_cap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives, and of the negatives those whose hash is below the chance that the classes give."""
    return sampling.cap_negatives(_long(spark, sf_dir), ratio=2.0).select("wid", "question", "label")


@query(f"""WITH {s.SCORED}, lg AS (SELECT doc_id AS wid, unnest(['goal', 'card']) AS question, unnest([quality, toxic]) AS label FROM sw), ok AS (SELECT * FROM lg WHERE label IS NOT NULL)
SELECT doc_id AS wid, CASE WHEN count(*) FILTER (question = 'goal') > 0 THEN 'goal=' || max(label) FILTER (question = 'goal') || ';' ELSE '' END || CASE WHEN count(*) FILTER (question = 'card') > 0 THEN 'card=' || max(label) FILTER (question = 'card') || ';' ELSE '' END AS gold, any_value(length(text)) AS n_chars
FROM ok JOIN sw ON sw.doc_id = ok.wid GROUP BY doc_id""")
def training_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a labelled window, without rebalancing, which is a random draw (see neg_cap_sample and upsample_round_robin)."""
    texts = b.scored_windows(spark, sf_dir).select(F.col("doc_id").alias("wid"), "text")
    got = sampling.training_cases(_long(spark, sf_dir), texts, rebalance=False)
    one = lambda q: F.when(F.col("gold")[q].isNotNull(), F.concat(F.lit(q + "="), F.col("gold")[q].cast("string"), F.lit(";"))).otherwise("")
    return got.select("wid", F.concat(one("goal"), one("card")).alias("gold"), F.char_length("text").cast("long").alias("n_chars"))


@query(f"""WITH {s.SCORED}, lg AS (SELECT doc_id AS wid, 'goal' AS question FROM sw WHERE quality = 1 UNION ALL SELECT doc_id, 'card' FROM sw WHERE toxic = 1), nn AS (SELECT question, count(*) AS n FROM lg GROUP BY question HAVING count(*) < 400),
rr AS (SELECT lg.wid, lg.question, n, row_number() OVER (PARTITION BY lg.question ORDER BY lg.wid) - 1 AS r FROM lg JOIN nn USING (question))
SELECT wid || '#up' || question || i AS wid, question, wid AS source_wid FROM (SELECT wid, question, unnest(range(r, 400 - n, n)) AS i FROM rr)""")
def upsample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.upsample(_long(spark, sf_dir), 400)


@query(f"""WITH {s.SCORED} SELECT doc_id AS wid, (CASE WHEN quality IS NOT NULL THEN 'goal=' || (1 - quality) || ',' || quality ELSE '' END) || ';' || (CASE WHEN toxic IS NOT NULL THEN 'card=' || (1 - toxic) || ',' || toxic ELSE '' END) AS targets FROM sw WHERE quality IS NOT NULL OR toxic IS NOT NULL""")
def calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.scored_windows(spark, sf_dir).select(F.col("doc_id").alias("wid"), F.col("quality").alias("goal"), F.col("toxic").alias("card"))
    got = calibrate.calibration_pairs(d)
    one = lambda q: F.when(F.col("targets")[q].isNotNull(), F.concat(F.lit(q + "="), F.col("targets")[q]["false"].cast("int").cast("string"), F.lit(","), F.col("targets")[q]["true"].cast("int").cast("string"))).otherwise("")
    return got.select("wid", F.concat(one("goal"), F.lit(";"), one("card")).alias("targets"))


# --- tables ---------------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT user_id, ts, event_type, value, event_id % 2 AS new, event_id FROM events)
SELECT user_id, event_type, arg_max(value, [epoch_us(ts), new]) AS value, max(ts)::TIMESTAMP AS ts FROM u GROUP BY user_id, event_type""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events")
    side = lambda k: e.where(F.col("event_id") % 2 == k).select("user_id", "event_type", "value", "ts")
    return sinks.upsert_latest(side(0), side(1), ["user_id", "event_type"])


@query("""SELECT conv_id AS match, turn AS line, CASE WHEN turn % 5 = 4 THEN 'not JSON' WHEN turn % 5 = 0 THEN (CASE WHEN turn % 2 = 0 THEN 'span' ELSE 'bad span' END) WHEN turn % 5 = 1 THEN 'intensity' WHEN turn % 5 = 2 THEN 'bad intensity' ELSE 'unknown kind' END AS kind_of FROM conversations""")
def teacher_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "conversations")
    k = F.col("turn")
    num = k.cast("string")
    value = (
        F.when(k % 5 == 4, F.concat(F.lit('{"kind": '), num)).when(k % 5 == 0, F.concat(F.lit('{"kind": "span", "q": "goal", "start": '), num, F.lit(', "end": '), F.when(k % 2 == 0, (k + 1).cast("string")).otherwise("-1"), F.lit("}")))
        .when(k % 5 == 1, F.concat(F.lit('{"kind": "intensity", "block": "B'), num, F.lit('", "level": "peak", "uncertain": true}'))).when(k % 5 == 2, F.lit('{"kind": "intensity", "block": "B1", "level": "loud"}')).otherwise(F.lit('{"kind": "other"}'))
    )
    return readers.teacher_lines(c.select(F.col("conv_id").alias("match"), k.alias("line"), value.alias("value"))).select("match", "line", "kind_of")


