"""Queries over word and event streams: clocks, windows, rules, triggers, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import align, events, text, triggers, windows
from tidemark.plans import bindings as b
from tidemark.plans import sql as s
from tidemark.sources.shared import written

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- clocks ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(epoch_ms(ts - date_trunc('day', ts)::TIMESTAMP) / 1000.0::DOUBLE, 3) AS sec FROM (SELECT event_id, ts FROM events)")
def parse_hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(scalar.parse_hms(F.date_format("ts", "HH:mm:ss.SSS")), 3).alias("sec"))


@query(f"""WITH {s.EVENTS}, x AS (SELECT event_id, t - 86400 AS d FROM ev), y AS (SELECT event_id, d, CAST(floor(abs(d)) AS BIGINT) AS n FROM x)
SELECT event_id, (CASE WHEN d < 0 THEN '-' ELSE '' END) || printf('%02d:%02d', n // 60, n % 60) AS clock FROM y""")
def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.events(spark, sf_dir).select("event_id", scalar.clock(F.col("t") - 86400).alias("clock"))


# --- words and windows ----------------------------------------------------------------------------------------------


def _cells(spark, sf_dir):
    out = windows.sliding_windows(b.words(spark, sf_dir), b.periods(spark, sf_dir))
    return out


_WINDOWS = f"""{s.WORDS}, {s.PERIODS},
k AS (SELECT match, period, audio_start, unnest(range(0, CAST(floor((audio_end + 10 - 20 - (audio_start - 10) + 1e-9) / 5) AS BIGINT) + 1)) AS k FROM pd),
sp AS (SELECT match, period, k, audio_start - 10 + k * 5.0::DOUBLE AS start, audio_start - 10 + k * 5.0::DOUBLE + 20 AS "end", audio_start FROM k),
win AS (SELECT sp.match, sp.period, sp.k, sp.start, sp."end", sp.start - sp.audio_start AS t_start, trim(coalesce(string_agg(word, '' ORDER BY pos), '')) AS text, count(word) AS n_words
  FROM sp LEFT JOIN wd ON wd.match = sp.match AND wd.start >= sp.start AND wd.start < sp."end" GROUP BY ALL)"""


@query(f"""WITH {_WINDOWS} SELECT match, period, printf('%d:%d:%.1f', match, period, start) AS wid, start, "end", t_start, text, n_words FROM win""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).drop("k")


@query(f"""WITH {_WINDOWS} SELECT match, start, coalesce(lag(text, 4) OVER (PARTITION BY match, period ORDER BY start), '') AS prev_text FROM win""")
def window_prev_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_prev_text(_cells(spark, sf_dir)).select("match", "start", "prev_text")


@query(f"""WITH {s.PERIODS}, k AS (SELECT match, period, audio_start, unnest(range(0, CAST(ceil((audio_end + 10 - (audio_start - 10)) / 20) AS BIGINT))) AS k FROM pd),
x AS (SELECT match, period, k, audio_start - 10 + k * 20.0::DOUBLE AS start, k * 20 - 10 AS d FROM k)
SELECT match, period, 'B' || lpad(CAST(row_number() OVER (PARTITION BY match ORDER BY period, start) AS VARCHAR), 4, '0') AS block, start, start + 20 AS "end",
(CASE WHEN d < 0 THEN '-' ELSE '' END) || printf('%02d:%02d', abs(d) // 60, abs(d) % 60) AS clock FROM x""")
def tumbling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.blocks(b.periods(spark, sf_dir))


@query(f"""WITH {s.WORDS} SELECT match, 1 AS period, min(start) AS "offset", min(start) AS audio_start, max("end") AS audio_end FROM wd GROUP BY match""")
def pseudo_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pseudo_align(b.words(spark, sf_dir))


@query(f"""WITH {s.WORDS}, {s.PERIODS}, p AS (SELECT match, 60.0::DOUBLE * n AS t, n FROM (SELECT conv_id AS match, unnest(range(0, CAST(greatest(7, max(turn)) AS BIGINT) + 1)) AS n FROM conversations GROUP BY conv_id))
SELECT p.match, n AS id, trim(coalesce(string_agg(word, '' ORDER BY pos), '')) AS text FROM p LEFT JOIN wd ON wd.match = p.match AND wd.start >= t + 5 AND wd.start < t + 12 GROUP BY p.match, n""")
def text_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes 0 to 7 of every conversation, and on to its last turn."""
    c = b.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("match")).agg(F.greatest(F.lit(7), F.max("turn").cast("int")).alias("_last"))
    spans = c.select("match", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("id")).select("match", "id", (F.col("id") * 60.0 + 5).alias("start"), (F.col("id") * 60.0 + 12).alias("end"))
    return text.text_between(b.words(spark, sf_dir), spans).select("match", "id", "text")


@query(f"""WITH {s.PERIODS}, {s.WORDS}, p AS (SELECT match, audio_start, audio_end, (audio_end - audio_start) / 60 + 3 AS len FROM pd),
q AS (SELECT match, pos AS id, start AS t FROM wd)
SELECT q.match, q.id, CASE WHEN t >= audio_start - 30 AND t <= audio_end + 30 THEN round((t - audio_start) / 60, 6) END AS minutes FROM q LEFT JOIN p ON p.match = q.match""")
def timeline_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = b.words(spark, sf_dir).select("match", F.col("pos").alias("id"), F.col("start").alias("t"))
    out = windows.match_minutes(points, b.periods(spark, sf_dir))
    return out.select("match", "id", F.round("minutes", 6).alias("minutes"))


#: Words one by one onto a stack; when its top says one n-gram five times over, the last n go.
_LOOPS = r"""lw AS (SELECT match, CASE WHEN match % 10 = 0 THEN pos * 5 + r ELSE pos END AS pos, start, "end", word FROM wd, (SELECT unnest(range(0, 5)) AS r) WHERE match % 10 = 0 OR r = 0),
ln AS (SELECT *, row_number() OVER (PARTITION BY match ORDER BY pos) AS n, regexp_replace(lower(word), '[^\p{L}\p{N}_\p{M}]+', '', 'g') AS w FROM lw),
lz AS (WITH RECURSIVE z AS (SELECT DISTINCT match, 0::BIGINT AS n, []::VARCHAR[] AS ws, []::BIGINT[] AS ps FROM ln
 UNION ALL SELECT match, n, CASE WHEN c > 0 THEN ws[1:len(ws) - c] ELSE ws END, CASE WHEN c > 0 THEN ps[1:len(ps) - c] ELSE ps END FROM (SELECT *, CASE
   WHEN len(ws) >= 5 AND ws[-1] <> '' AND ws[-5:-2] = ws[-4:] THEN 1 WHEN len(ws) >= 10 AND array_to_string(ws[-2:], '') <> '' AND ws[-10:-3] = ws[-8:] THEN 2
   WHEN len(ws) >= 15 AND array_to_string(ws[-3:], '') <> '' AND ws[-15:-4] = ws[-12:] THEN 3 ELSE 0 END AS c
  FROM (SELECT z.match, ln.n, list_append(z.ws, ln.w) AS ws, list_append(z.ps, CAST(ln.pos AS BIGINT)) AS ps FROM z JOIN ln ON ln.match = z.match AND ln.n = z.n + 1))) SELECT * FROM z)"""


@query(f"""WITH {s.WORDS}, {_LOOPS}, kp AS (SELECT match, unnest(ps) AS pos FROM lz QUALIFY row_number() OVER (PARTITION BY match ORDER BY n DESC) = 1) SELECT ln.match, ln.pos, start, "end", word FROM ln JOIN kp ON kp.match = ln.match AND kp.pos = ln.pos""")
def loop_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth conversation says each of its words five times over, so that there is something to cut."""
    w = b.words(spark, sf_dir)
    again = w.where("match % 10 = 0").withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    looped = again.select("match", (F.col("pos") * 5 + F.col("_n")).alias("pos"), "start", "end", "word")
    return text.cut_loops(looped.unionByName(w.where("match % 10 <> 0")))


@query(f"""WITH {s.WORDS}, {s.PERIODS}, o AS (SELECT match, audio_start - 10 AS o FROM pd), x AS (SELECT wd.match, CAST(floor((start - o) / 20) AS BIGINT) AS k, pos, start, word FROM wd JOIN o USING (match) JOIN pd USING (match)
  WHERE start < o + 20 * ceil((audio_end + 10 - (audio_start - 10)) / 20)),
r AS (SELECT match, k, pos, start, word, row_number() OVER (PARTITION BY match, k ORDER BY start, pos) AS n FROM x),
f AS (WITH RECURSIVE g AS (SELECT match, k, n, start AS b, 0 AS line, start - start >= 5 AS closed, word FROM r WHERE n = 1
  UNION ALL SELECT r.match, r.k, r.n, CASE WHEN closed THEN r.start ELSE b END, CASE WHEN closed THEN line + 1 ELSE line END, r.start - (CASE WHEN closed THEN r.start ELSE b END) >= 5, r.word FROM g JOIN r ON r.match = g.match AND r.k = g.k AND r.n = g.n + 1) SELECT * FROM g)
SELECT match, 'B' || lpad(CAST(k + 1 AS VARCHAR), 4, '0') AS block, line, b AS line_start, string_agg(word, '' ORDER BY n) AS text FROM f GROUP BY match, k, line, b""")
def pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.pack_lines(b.words(spark, sf_dir), windows.blocks(b.periods(spark, sf_dir)))


@query("""SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), 'amara\\.org|legendas? (pela|por)|obrigad[oa] por assistir|inscreva-se|ative o sininho|legendado por|tradução e legendas|www\\.|\\.com([^\\p{L}\\p{N}_\\p{M}]|$)')""")
def hallucination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").where(text.not_stock(F.col("text"))).select("doc_id")


@query(f"""WITH {s.EVENTS} SELECT event_id FROM ev WHERE NOT (coalesce(CASE WHEN event_id % 3 > 0 THEN value / 100 END, 0) > 0.8 AND coalesce(CASE WHEN event_id % 5 > 0 THEN -value / 50 END, 0) < -1.0)""")
def silent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    return e.where(text.not_silent(F.when(F.col("event_id") % 3 > 0, F.col("value") / 100), F.when(F.col("event_id") % 5 > 0, -F.col("value") / 50))).select("event_id")


# --- rules ----------------------------------------------------------------------------------------------------------


@query(f"WITH {s.SCORED}, {s.HITS} SELECT doc_id, goal, big_chance, controversy, card, intensity FROM h")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.rule_hits(b.scored_windows(spark, sf_dir), rules=b.RULES).select("doc_id", *b.RULES, "intensity")


@query(f"""WITH {s.SCORED}, {s.HITS} SELECT doc_id, least(1.0, goal / 20) AS goal_score, CAST(goal >= 20 AS INT) AS goal_pred, least(1.0, card / 10) AS card_score, CAST(card >= 10 AS INT) AS card_pred,
CAST(intensity AS DOUBLE) AS intensity_score, CASE WHEN intensity < 20 THEN 0 WHEN intensity < 60 THEN 1 ELSE 2 END AS intensity_pred FROM h""")
def keyword_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.rule_predict(text.rule_hits(b.scored_windows(spark, sf_dir), rules=b.RULES), {"goal": 20, "card": 10}, (20, 60))
    return found.select("doc_id", "goal_score", "goal_pred", "card_score", "card_pred", "intensity_score", "intensity_pred")


@query(f"""WITH {s.WORDS}, c AS (SELECT match, start, lower(trim(word)) AS w0, pos, row_number() OVER (PARTITION BY match ORDER BY pos) AS n FROM wd),
x AS (SELECT match, start, w0 || coalesce(' ' || lead(w0, 1) OVER o, '') || coalesce(' ' || lead(w0, 2) OVER o, '') || coalesce(' ' || lead(w0, 3) OVER o, '') AS ctx FROM c WINDOW o AS (PARTITION BY match ORDER BY n))
SELECT match, 'the_call' AS cue, start AS t FROM x WHERE regexp_matches(ctx, '^the([^\\p{{L}}\\p{{N}}_\\p{{M}}]|$)') UNION ALL SELECT match, 'of_call', start FROM x WHERE regexp_matches(ctx, '^of (a|the)([^\\p{{L}}\\p{{N}}_\\p{{M}}]|$)')
UNION ALL SELECT match, 'and_call', start FROM x WHERE regexp_matches(ctx, '^and([^\\p{{L}}\\p{{N}}_\\p{{M}}]|$)') UNION ALL SELECT match, 'in_call', start FROM x WHERE regexp_matches(ctx, '^in([^\\p{{L}}\\p{{N}}_\\p{{M}}]|$)')""")
def cue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.cue_hits(b.words(spark, sf_dir), b.CUES)


# --- triggers -------------------------------------------------------------------------------------------------------


def _positives(spark, sf_dir):
    e = b.events(spark, sf_dir).where("event_type in ('purchase', 'click')")
    return e.select("match", F.col("event_type").alias("question"), F.col("t").alias("start"), (F.col("t") + 1200).alias("end"), "xg").withColumnRenamed("xg", "prob")


_POS = f"""{s.EVENTS}, pos AS (SELECT match, event_type AS question, t AS start, t + 1200 AS "end", xg AS prob FROM ev WHERE event_type IN ('purchase', 'click'))"""


@query(f"""WITH {_POS}, a AS (SELECT *, max("end") OVER (PARTITION BY match, question ORDER BY start, "end", prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pos),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR start - r > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY match, question ORDER BY start, "end", prob ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT match, question, min(start) AS start, max("end") AS "end", max(prob) AS prob, arg_min((start + "end") / 2, [-prob, start, "end"]) AS peak FROM i GROUP BY match, question, g""")
def merge_triggers_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.merge_uncapped(_positives(spark, sf_dir), ["match", "question"], 21600.0)


_FOLD = """{pos}, r AS (SELECT *, row_number() OVER (PARTITION BY match, question ORDER BY start, "end", prob) AS n FROM pos),
g AS (WITH RECURSIVE z AS (SELECT match, question, n, 1 AS trig, start AS s, "end" AS e, prob AS p, (start + "end") / 2 AS peak FROM r WHERE n = 1
 UNION ALL SELECT r.match, r.question, r.n, CASE WHEN j THEN trig ELSE trig + 1 END, CASE WHEN j THEN s ELSE r.start END, CASE WHEN j THEN greatest(e, r."end") ELSE r."end" END,
  CASE WHEN j AND p >= r.prob THEN p ELSE r.prob END, CASE WHEN j AND p >= r.prob THEN peak ELSE (r.start + r."end") / 2 END
 FROM (SELECT z.*, q.n AS n2, q.start AS qs, q."end" AS qe, q.start - z.e <= {gap} AND q."end" - z.s <= {cap} AS j FROM z JOIN r q ON q.match = z.match AND q.question = z.question AND q.n = z.n + 1) y
 JOIN r ON r.match = y.match AND r.question = y.question AND r.n = y.n2) SELECT * FROM z),
trg AS (SELECT match, question, s AS start, e AS "end", p AS prob, peak FROM (SELECT *, row_number() OVER (PARTITION BY match, question, trig ORDER BY n DESC) AS k FROM g) WHERE k = 1)"""


@query(f"""WITH {_FOLD.format(pos=_POS, gap=21600, cap=86400)} SELECT match, question, start, "end", prob, peak FROM trg""")
def merge_triggers_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.merge_capped(_positives(spark, sf_dir), ["match", "question"], 21600.0, 86400.0)


@query(f"""WITH {s.EVENTS}, x AS (SELECT match, t, coalesce(t - lag(t) OVER (PARTITION BY match ORDER BY t) > 3600, true) AS new FROM ev), y AS (SELECT match, t, sum(CAST(new AS INT)) OVER (PARTITION BY match ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM x)
SELECT match, round(avg(t), 4) AS t, count(*) AS n FROM y GROUP BY match, i""")
def dedupe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triggers.dedupe_moments(b.events(spark, sf_dir).select("match", "t"), ["match"], 3600.0)
    return out.select("match", F.round("t", 4).alias("t"), "n")


@query(f"""WITH {s.EVENTS}, x AS (SELECT match, t, event_type, coalesce(t - lag(t) OVER (PARTITION BY match ORDER BY t, event_type) > 3600, true) AS new FROM ev), y AS (SELECT match, t, event_type, sum(CAST(new AS INT)) OVER (PARTITION BY match ORDER BY t, event_type ROWS UNBOUNDED PRECEDING) AS i FROM x)
SELECT match, min(t) AS t_first, max(t) AS t_last, (min(t) + max(t)) / 2 AS t, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM y GROUP BY match, i""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triggers.candidate_pool(b.events(spark, sf_dir).select("match", "t", F.col("event_type").alias("source")), ["match"], 3600.0)
    return out.withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {s.EVENTS}, c AS (SELECT match, event_id AS seq, t AS start, t + value * 60 AS "end" FROM ev), x AS (SELECT *, coalesce(start - lag("end") OVER (PARTITION BY match ORDER BY seq) > 14400, true) AS new FROM c),
y AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY match ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i FROM x), z AS (SELECT *, first_value(start) OVER (PARTITION BY match, i ORDER BY seq) AS b FROM y)
SELECT match, b AS start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY match ORDER BY "end" - b DESC, seq) AS k FROM z) WHERE k = 1""")
def longest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    return triggers.longest_block(e.select("match", F.col("event_id").alias("seq"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end")), ["match"], 14400.0)


@query(f"""WITH {s.EVENTS} SELECT match, round(count(DISTINCT CASE WHEN t >= 86400 AND t < 864000 THEN floor((t - 86400) / 3600) END) / 216.0::DOUBLE, 9) AS coverage FROM ev GROUP BY match""")
def bin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir).select("match", F.col("t").alias("start"))
    return triggers.bin_coverage(e, ["match"], F.lit(86400.0), F.lit(864000.0), 3600.0).select("match", F.round("coverage", 9).alias("coverage"))


@query(f"""WITH {_FOLD.format(pos=_POS, gap=21600, cap=86400)}, x AS (SELECT match, CASE question WHEN 'purchase' THEN 'goal' ELSE 'big_chance' END AS question, start, "end", prob,
 'P1 ' || printf('%02d:%02d', CAST(floor(start) AS BIGINT) // 60, CAST(floor(start) AS BIGINT) % 60) AS clock FROM trg),
k AS (SELECT *, row_number() OVER (PARTITION BY match ORDER BY start, question) - 1 AS n FROM x WHERE question = 'goal' OR prob >= 0.3)
SELECT match, printf('%02d', n) || '_' || question || '_' || replace(replace(clock, ' ', '_'), ':', 'm') AS name, question, greatest(0.0, start - 600) AS start, "end" + 300 AS "end" FROM k""")
def clip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triggers.merge_capped(_positives(spark, sf_dir), ["match", "question"], 21600.0, 86400.0)
    h = t.select("match", F.when(F.col("question") == "purchase", "goal").otherwise("big_chance").alias("question"), "start", "end", F.concat(F.lit("P1 "), scalar.clock(F.col("start"))).alias("clock"), F.col("prob").alias("peak_prob"))
    return triggers.clip_plan(h, ["goal", "big_chance"], 0.3, 600.0, 300.0)


@query(f"""WITH {_WINDOWS}, hh AS (SELECT match, start, "end", len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda x: x = 'the')) AS c FROM win),
pos AS (SELECT match, 'goal' AS question, start, "end", least(1.0, c / 3) AS prob FROM hh WHERE c >= 2),
{_FOLD.format(pos="q0 AS (SELECT 1)", gap=30, cap=120)} SELECT match, question, start, "end", round(prob, 9) AS prob, peak FROM trg""")
def window_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: words to windows, rule hits, a threshold, and capped triggers."""
    found = text.rule_hits(_cells(spark, sf_dir).select("match", "start", "end", "text"), rules={"goal": b.RULES["goal"]})
    pos = found.where("goal >= 2").select("match", F.lit("goal").alias("question"), "start", "end", F.least(F.lit(1.0), F.col("goal") / 3).alias("prob"))
    return triggers.merge_capped(pos, ["match", "question"]).withColumn("prob", F.round("prob", 9))


# --- events ---------------------------------------------------------------------------------------------------------


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as raw match events: clicks are shots, purchases fouls, errors misconduct, signups passes."""
    e = b.table(spark, sf_dir, "events")
    k, v = F.col("event_id"), F.col("value")
    name = (
        F.when(k % 50 == 0, "Half Start").when(k % 50 == 1, "Half End").when(F.col("event_type") == "click", F.when(k % 17 == 0, "Own Goal For").otherwise("Shot"))
        .when(F.col("event_type") == "purchase", "Foul Committed").when(F.col("event_type") == "error", "Bad Behaviour").when(F.col("event_type") == "signup", "Pass")
        .otherwise(F.when(k % 3 == 0, "Offside").when(k % 3 == 1, "Substitution").otherwise("Carry"))
    )
    of = lambda c: F.struct(c.alias("name"))
    card = lambda m: F.when(k % m == 0, of(F.when(k % (2 * m) == 0, F.lit("Yellow Card")).otherwise("Red Card")))
    outcome = F.when(k % 7 == 0, "Goal").when(k % 7 == 1, "Post").otherwise("Saved")
    return e.select(
        F.col("user_id").alias("match"), k.cast("string").alias("id"), of(name).alias("type"), (1 + k % 5).cast("int").alias("period"), F.date_format("ts", "HH:mm:ss.SSS").alias("timestamp"),
        F.minute("ts").alias("minute"), F.second("ts").alias("second"), of(F.concat(F.lit("team"), (k % 2).cast("string"))).alias("team"), F.when(k % 4 > 0, of(F.concat(F.lit("p"), (k % 23).cast("string")))).alias("player"),
        F.when(name == "Shot", F.struct((v / 100).alias("statsbomb_xg"), of(outcome).alias("outcome"), of(F.when(k % 9 == 0, F.lit("Penalty")).otherwise("Open Play")).alias("type"))).alias("shot"),
        F.when(name == "Foul Committed", F.struct((k % 4 == 0).alias("penalty"), card(3).alias("card"))).alias("foul_committed"),
        F.when(name == "Bad Behaviour", F.struct(card(2).alias("card"))).alias("bad_behaviour"),
        F.when(name == "Pass", F.struct(F.when(k % 2 == 0, of(F.lit("Corner"))).alias("type"))).alias("pass"),
    )


_RAW = """raw AS (SELECT user_id AS match, event_id AS k, value AS v, 1 + event_id % 5 AS period, round(epoch_ms(ts - date_trunc('day', ts)::TIMESTAMP) / 1000.0::DOUBLE, 3) AS t,
 CASE WHEN event_id % 50 = 0 THEN 'Half Start' WHEN event_id % 50 = 1 THEN 'Half End' WHEN event_type = 'click' THEN (CASE WHEN event_id % 17 = 0 THEN 'Own Goal For' ELSE 'Shot' END) WHEN event_type = 'purchase' THEN 'Foul Committed'
  WHEN event_type = 'error' THEN 'Bad Behaviour' WHEN event_type = 'signup' THEN 'Pass' WHEN event_id % 3 = 0 THEN 'Offside' WHEN event_id % 3 = 1 THEN 'Substitution' ELSE 'Carry' END AS name,
 CASE WHEN event_id % 7 = 0 THEN 'Goal' WHEN event_id % 7 = 1 THEN 'Post' ELSE 'Saved' END AS outcome, CASE WHEN event_id % 9 = 0 THEN 'Penalty' ELSE 'Open Play' END AS st FROM events),
ne AS (SELECT match, CAST(k AS VARCHAR) AS sb_id, period, t, 'shot' AS type, round(v / 100, 4) AS xg, outcome, st AS shot_type, period = 5 AS shootout, NULL::VARCHAR AS card, NULL::VARCHAR AS via FROM raw WHERE name = 'Shot'
 UNION ALL SELECT match, CAST(k AS VARCHAR), period, t, 'goal', round(v / 100, 4), NULL, st, NULL, NULL, NULL FROM raw WHERE name = 'Shot' AND outcome = 'Goal' AND period <> 5
 UNION ALL SELECT match, CAST(k AS VARCHAR), period, t, 'own_goal', NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE name = 'Own Goal For'
 UNION ALL SELECT match, CAST(k AS VARCHAR), period, t, 'penalty_foul', NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE name = 'Foul Committed' AND k % 4 = 0
 UNION ALL SELECT match, CAST(k AS VARCHAR), period, t, 'card', NULL, NULL, NULL, NULL, CASE WHEN k % 6 = 0 THEN 'Yellow Card' ELSE 'Red Card' END, 'foul' FROM raw WHERE name = 'Foul Committed' AND k % 3 = 0
 UNION ALL SELECT match, CAST(k AS VARCHAR), period, t, 'card', NULL, NULL, NULL, NULL, CASE WHEN k % 4 = 0 THEN 'Yellow Card' ELSE 'Red Card' END, 'bad_behaviour' FROM raw WHERE name = 'Bad Behaviour' AND k % 2 = 0
 UNION ALL SELECT match, CAST(k AS VARCHAR), period, t, CASE name WHEN 'Pass' THEN 'corner' WHEN 'Substitution' THEN 'substitution' ELSE 'offside' END, NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE name IN ('Substitution', 'Offside') OR (name = 'Pass' AND k % 2 = 0)
 UNION ALL SELECT match, NULL, period, min(t), 'period_start', NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE name = 'Half Start' GROUP BY match, period
 UNION ALL SELECT match, NULL, period, max(CASE WHEN name = 'Half End' THEN t END), 'period_end', NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE name IN ('Half Start', 'Half End') GROUP BY match, period HAVING count(*) FILTER (name = 'Half Start') > 0)"""


@query(f"WITH {_RAW} SELECT * FROM ne")
def event_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalize(raw_events(spark, sf_dir)).select("match", "sb_id", "period", "t", "type", "xg", "outcome", "shot_type", "shootout", "card", "via")


@query(f"""WITH {_RAW} SELECT match, count(*) FILTER (type IN ('goal', 'own_goal')) AS goals, count(*) FILTER (type = 'goal' AND shot_type = 'Penalty') AS pens_scored, count(*) FILTER (type = 'card' AND card = 'Yellow Card') AS yellow,
count(*) FILTER (type = 'card' AND card = 'Second Yellow') AS second_yellow, count(*) FILTER (type = 'card' AND card = 'Red Card') AS red, count(*) FILTER (type = 'penalty_foul') AS penalty_fouls,
count(*) FILTER (type = 'shot' AND NOT shootout AND outcome <> 'Goal' AND (xg >= 0.3 OR outcome IN ('Post', 'Saved to Post'))) AS big_chance_shots, count(*) FILTER (type = 'shot' AND NOT shootout) AS shots,
count(*) FILTER (type = 'corner') AS corners, count(*) FILTER (type = 'substitution') AS subs, coalesce(string_agg(period || '=' || printf('%.1f', round(t / 60, 1)), ';' ORDER BY period) FILTER (type = 'period_end' AND t > 0), '') AS periods FROM ne GROUP BY match""")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.summarize(events.normalize(raw_events(spark, sf_dir)))
    told = F.array_join(F.transform(F.map_entries("periods"), lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.format_string("%.1f", x["value"]))), ";")
    return out.withColumn("periods", told)


# --- alignment ------------------------------------------------------------------------------------------------------


def _anchors(spark, sf_dir):
    """Turns as anchors: the time of each within its conversation, 90 s early, of a kind by its number."""
    c = b.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "goal").when(F.col("turn") % 3 == 1, "corner").otherwise("shot")
    return c.select(F.col("conv_id").alias("match"), F.lit(1).alias("period"), F.col("turn").cast("int").alias("anchor"), kind.alias("kind"), (F.col("turn") * 60.0 - 90.0).alias("t"))


def _hits(spark, sf_dir):
    """Cue hits, as a table: a fit reads them several times."""
    return written(text.cue_hits(b.words(spark, sf_dir), b.CUES), "cue-hits")


_CUE = r"""cu AS (SELECT * FROM (VALUES ('the_call', 'goal', 0, 2.0::DOUBLE, 30.0::DOUBLE, 5.0::DOUBLE), ('of_call', 'goal', 1, 20.0, 30.0, 5.0), ('and_call', 'corner', 2, -12.0, 40.0, 1.0), ('in_call', 'shot', 3, 1.0, 12.0, 1.0)) q(cue, kind, place, lag, cap, weight)),
an AS (SELECT conv_id AS match, CAST(turn AS INT) AS anchor, CASE turn % 3 WHEN 0 THEN 'goal' WHEN 1 THEN 'corner' ELSE 'shot' END AS kind, turn * 60.0::DOUBLE - 90.0::DOUBLE AS t FROM conversations)"""
_HIT = "ch AS (" + ORACLE["cue_hits"].replace("WITH ", "WITH ", 1) + ")"


def _costs(n: str = "") -> str:
    """Each anchor at each offset of a grid gr: cost and residual of its best cue (bm). A nearest hit is one of the two ASOF neighbours."""
    return f"""pr{n} AS (SELECT g.match, g.anchor, g.o, cu.cue, cu.place, cu.cap, cu.weight, g.o + g.t + cu.lag AS pred FROM gr{n} g JOIN cu ON cu.kind = g.kind),
lo{n} AS (SELECT pr.*, h.t AS lo FROM pr{n} pr ASOF LEFT JOIN ch h ON h.match = pr.match AND h.cue = pr.cue AND h.t <= pr.pred),
nb{n} AS (SELECT lo.*, h.t AS hi FROM lo{n} lo ASOF LEFT JOIN ch h ON h.match = lo.match AND h.cue = lo.cue AND h.t >= lo.pred),
nr{n} AS (SELECT *, CASE WHEN hi IS NULL OR pred - lo <= hi - pred THEN lo ELSE hi END AS near FROM nb{n}),
cd{n} AS (SELECT *, CASE WHEN abs(near - pred) <= cap THEN near - pred END AS d FROM nr{n}),
cc{n} AS (SELECT *, weight * coalesce(abs(d), cap) AS c FROM cd{n}),
bm{n} AS (SELECT match, anchor, o, c AS cost, d AS residual FROM (SELECT *, row_number() OVER (PARTITION BY match, anchor, o ORDER BY c, place) AS k FROM cc{n}) WHERE k = 1)"""


_COST = _costs()


@query(f"""WITH {_HIT}, {_CUE}, gr AS (SELECT match, anchor, kind, t, 85.0::DOUBLE AS o FROM an), {_COST} SELECT match, anchor, round(cost, 6) AS cost, round(residual, 6) AS residual FROM bm""")
def nearest_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cue of every anchor at an offset of 85 s."""
    found = align.best_match(_anchors(spark, sf_dir).withColumn("offset", F.lit(85.0)), _hits(spark, sf_dir), align.cue_table(spark, b.CUES), ["period", "anchor"])
    return found.select("match", "anchor", F.round("cost", 6).alias("cost"), F.round("residual", 6).alias("residual"))


def _search(spark, sf_dir, radius: float = 1200.0):
    return _anchors(spark, sf_dir).select("match", "period").distinct().select("match", "period", F.lit(86.0).alias("center"), F.lit(radius).alias("radius"))


_GRID = "gr AS (SELECT match, anchor, kind, t, 86.0::DOUBLE - 1200 + i AS o FROM an, (SELECT unnest(range(0, 2401)) AS i))"


@query(f"WITH {_HIT}, {_CUE}, {_GRID}, {_COST} SELECT match, o AS \"offset\", round(sum(cost), 6) AS cost FROM bm GROUP BY match, o")
def offset_cost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.offset_costs(_anchors(spark, sf_dir), _hits(spark, sf_dir), align.cue_table(spark, b.CUES), _search(spark, sf_dir))
    return found.select("match", "offset", F.round("cost", 6).alias("cost"))


def _lowest(name: str, costs: str) -> str:
    return f"{name} AS (SELECT match, o, cost FROM (SELECT match, o, round(sum(cost), 9) AS cost, row_number() OVER (PARTITION BY match ORDER BY round(sum(cost), 9), o) AS k FROM {costs} GROUP BY match, o) WHERE k = 1)"


def _first_low(name: str, costs: str) -> str:
    """On a grid, the smallest offset whose cost is within a millionth of the least."""
    return f"{name}s AS (SELECT match, o, sum(cost) AS cost FROM {costs} GROUP BY match, o), {name} AS (SELECT match, min(o) AS o FROM (SELECT match, o, cost, min(cost) OVER (PARTITION BY match) AS m FROM {name}s) WHERE cost <= m + 1e-6 GROUP BY match)"


_FITTED = f"""{_HIT}, {_CUE}, {_GRID}, {_COST}, {_first_low('co', 'bm')}, gr2 AS (SELECT an.match, anchor, kind, t, co.o - 1 + 0.25::DOUBLE * i AS o FROM an JOIN co ON co.match = an.match, (SELECT unnest(range(0, 9)) AS i)),
{_costs('2')}, {_lowest('ft', 'bm2')}"""


@query(f"""WITH {_FITTED} SELECT match, o AS "offset", round(cost, 6) AS cost FROM ft""")
def fit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.fit_offset(_anchors(spark, sf_dir), _hits(spark, sf_dir), align.cue_table(spark, b.CUES), _search(spark, sf_dir))
    return found.select("match", "offset", F.round("cost", 6).alias("cost"))


def _residuals(spark, sf_dir):
    anchors, hits, cues = _anchors(spark, sf_dir), _hits(spark, sf_dir), align.cue_table(spark, b.CUES)
    fitted = align.fit_offset(anchors, hits, cues, _search(spark, sf_dir))
    return align.loo_residuals(anchors, hits, cues, fitted)


_REST = """tt{n} AS (SELECT match, o, sum(cost) AS total FROM bm{n} GROUP BY match, o)"""
_LOO = f"""{_FITTED}, gr3 AS (SELECT an.match, anchor, kind, t, ft.o - 120 + i AS o FROM an JOIN ft ON ft.match = an.match, (SELECT unnest(range(0, 241)) AS i)), {_costs('3')}, {_REST.format(n=3)},
lc AS (SELECT match, anchor, min(o) AS o FROM (SELECT bm3.match, bm3.anchor, bm3.o, total - cost AS rest, min(total - cost) OVER (PARTITION BY bm3.match, bm3.anchor) AS m FROM bm3 JOIN tt3 ON tt3.match = bm3.match AND tt3.o = bm3.o) WHERE rest <= m + 1e-6 GROUP BY match, anchor),
lf AS (SELECT match, anchor, o - 1 + 0.25::DOUBLE * i AS o FROM lc, (SELECT unnest(range(0, 9)) AS i)), gr4 AS (SELECT an.match, anchor, kind, t, q.o FROM an JOIN (SELECT DISTINCT match, o FROM lf) q ON q.match = an.match), {_costs('4')}, {_REST.format(n=4)},
lx AS (SELECT match, anchor, o FROM (SELECT lf.match, lf.anchor, lf.o, row_number() OVER (PARTITION BY lf.match, lf.anchor ORDER BY round(total - cost, 9), lf.o) AS k FROM lf JOIN bm4 ON bm4.match = lf.match AND bm4.anchor = lf.anchor AND bm4.o = lf.o JOIN tt4 ON tt4.match = lf.match AND tt4.o = lf.o) WHERE k = 1),
na AS (SELECT match, count(*) AS n FROM an GROUP BY match),
gr5 AS (SELECT an.match, an.anchor, an.kind, an.t, CASE WHEN n > 1 THEN lx.o ELSE ft.o END AS o FROM an JOIN lx ON lx.match = an.match AND lx.anchor = an.anchor JOIN ft ON ft.match = an.match JOIN na ON na.match = an.match), {_costs('5')},
gr6 AS (SELECT an.match, anchor, kind, t, ft.o FROM an JOIN ft ON ft.match = an.match), {_costs('6')},
lr AS (SELECT an.match, an.anchor, an.kind, round(bm6.residual, 2) AS fit_residual, round(bm5.residual, 2) AS loo_residual, bm5.o AS loo_offset FROM an JOIN bm5 ON bm5.match = an.match AND bm5.anchor = an.anchor JOIN bm6 ON bm6.match = an.match AND bm6.anchor = an.anchor)"""


@query(f"WITH {_LOO} SELECT match, anchor, kind, fit_residual, loo_residual, loo_offset FROM lr")
def loo_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor against a fit of all anchors, and against one without it."""
    return _residuals(spark, sf_dir).select("match", "anchor", "kind", "fit_residual", "loo_residual", "loo_offset")


@query(f"""WITH {_LOO} SELECT kind, count(*) AS n, count(loo_residual) AS found, round(median(abs(loo_residual)), 1) AS median_abs, round(max(abs(loo_residual)), 1) AS max_abs FROM lr GROUP BY kind""")
def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.residual_summary(_residuals(spark, sf_dir), [])


_ENDS = """en AS (SELECT match, audio_end - audio_start AS length_s FROM pd)"""


@query(f"""WITH {_HIT}, {s.PERIODS}, {_CUE}, {_ENDS}, gr AS (SELECT match, anchor, kind, t, -1100.0::DOUBLE + i AS o FROM an, (SELECT unnest(range(0, 2401)) AS i)), {_COST}, {_first_low('co', 'bm')},
gr2 AS (SELECT an.match, anchor, kind, t, co.o - 1 + 0.25::DOUBLE * i AS o FROM an JOIN co ON co.match = an.match, (SELECT unnest(range(0, 9)) AS i)), {_costs('2')}, {_lowest('ft', 'bm2')}
SELECT ft.match, 1 AS period, o AS "offset", o AS audio_start, o + length_s AS audio_end, length_s, 100.0::DOUBLE AS search_center FROM ft JOIN en ON en.match = ft.match""")
def align_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's clock from a hint of 100 s, sought 1,200 s to either side."""
    anchors = _anchors(spark, sf_dir)
    ends = b.periods(spark, sf_dir).select("match", "period", (F.col("audio_end") - F.col("audio_start")).alias("t"))
    hints = ends.select("match", F.lit(100.0).alias("hint"))
    return align.align(anchors, _hits(spark, sf_dir), align.cue_table(spark, b.CUES), ends, hints)


@query(f"""WITH {_RAW}, k AS (SELECT match, period, CASE type WHEN 'own_goal' THEN 'goal' ELSE type END AS kind, t FROM ne WHERE type IN ('goal', 'own_goal', 'corner', 'shot', 'period_start', 'period_end') AND t IS NOT NULL)
SELECT match, period, kind, t, row_number() OVER (PARTITION BY match, period ORDER BY t, kind) AS anchor FROM k""")
def anchors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.anchors_of(events.normalize(raw_events(spark, sf_dir))).select("match", "period", "kind", "t", "anchor")


@query("""SELECT conv_id AS match, CAST(CASE WHEN conv_id % 3 = 0 THEN conv_id * 10 - 7 ELSE 0 END AS DOUBLE) AS hint FROM (SELECT DISTINCT conv_id FROM conversations)""")
def kickoff_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the streams were live, one third weren't and of one third nothing is known."""
    m = b.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("match")).distinct()
    registry = m.select("match", F.timestamp_seconds(F.col("match") * 10).alias("kickoff"))
    known = m.where("match % 3 < 2").select("match", F.when(F.col("match") % 3 == 0, "was_live").otherwise("not_live").alias("live_status"), F.lit(7).cast("long").alias("release_ts"))
    return align.kickoff_hint(registry, known)


# Of one raw event, a goal is listed after its shot and a card after its foul, as normalize lists them.
@query(f"""WITH {_RAW}, o AS (SELECT match, type, period, t, coalesce(sb_id, '') AS sb_id FROM ne)
SELECT *, row_number() OVER (PARTITION BY match ORDER BY period, t NULLS LAST, sb_id = '', sb_id, CASE type WHEN 'goal' THEN 1 WHEN 'card' THEN 1 ELSE 0 END, type) AS seq FROM o""")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of all events of each match."""
    return events.normalize(raw_events(spark, sf_dir)).select("match", "type", "period", "t", F.coalesce("sb_id", F.lit("")).alias("sb_id"), F.col("seq").cast("long").alias("seq"))


@query(f"""WITH {_RAW}, o AS (SELECT match, type, period, t, coalesce(sb_id, '') AS sb_id FROM ne) SELECT match, type, period, t, sb_id FROM o QUALIFY row_number() OVER (PARTITION BY match ORDER BY period, t NULLS LAST, sb_id = '', sb_id, CASE type WHEN 'goal' THEN 1 WHEN 'card' THEN 1 ELSE 0 END, type) <= 3""")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three events of each match, by seq (a report of what a stream begins with)."""
    return events.normalize(raw_events(spark, sf_dir)).where("seq <= 3").select("match", "type", "period", "t", F.coalesce("sb_id", F.lit("")).alias("sb_id"))


# --- from segments to words -----------------------------------------------------------------------------------------


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of recognised speech: their words with times, every seventh of them blank."""
    w = b.words(spark, sf_dir)
    said = F.struct("start", "end", F.when(F.col("pos") % 7 == 0, F.lit("  ")).otherwise(F.col("word")).alias("word"), F.lit(0.5).alias("p"))
    return w.groupBy("match", F.floor(F.col("pos") / 100000).alias("turn")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(said)).alias("words"))


@query(f"""WITH {s.WORDS} SELECT match, row_number() OVER (PARTITION BY match ORDER BY start, turn, pos) AS pos, start, word FROM (SELECT match, pos // 100000 AS turn, pos, start, word FROM wd WHERE pos % 7 <> 0)""")
def words_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.words_of_segments(segments(spark, sf_dir)).select("match", "pos", "start", "word")


@query(r"""SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}_\p{M}]+', '', 'g') AS norm FROM documents""")
def token_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", text.token_norm(F.col("text")).alias("norm"))


@query(f"""WITH {s.WORDS}, {s.PERIODS}, h AS (SELECT match, audio_start, audio_end FROM pd WHERE match % 2 = 0 UNION ALL SELECT match, min(start), max("end") FROM wd WHERE match % 2 = 1 GROUP BY match) SELECT match, 1 AS period, audio_start AS "offset", audio_start, audio_end FROM h""")
def with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of even conversations; for the others, one period from the first word to the last."""
    return windows.with_fallback(b.periods(spark, sf_dir).where("match % 2 = 0"), b.words(spark, sf_dir))


@query(f"""WITH {s.WORDS}, {s.PERIODS}, {s.EVENTS} SELECT wd.match, CAST(count(*) AS BIGINT) AS n_words FROM wd JOIN pd USING (match) WHERE wd.start >= greatest(0, audio_start + 60 - 1500) AND wd.start <= least(audio_start + 60 + 155 * 60 + (CASE WHEN wd.match % 2 = 0 THEN 2400 ELSE 0 END) + (CASE WHEN wd.match % 3 = 0 THEN 900 ELSE 0 END), 240.0) GROUP BY wd.match""")
def speech_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words lie in the part of each stream that is worth transcribing; streams are four minutes long."""
    from tidemark.sources import readers

    p = b.periods(spark, sf_dir)
    hints = p.select("match", (F.col("audio_start") + 60).alias("hint"), F.lit(240.0).alias("duration"))
    seen = p.select("match", F.explode(F.array(F.lit(1), F.when(F.col("match") % 2 == 0, 3).otherwise(2), F.when(F.col("match") % 3 == 0, 5).otherwise(2))).alias("period"))
    w = b.words(spark, sf_dir).join(readers.speech_window(hints, seen), "match")
    return w.where((F.col("start") >= F.col("from_s")) & (F.col("start") <= F.coalesce("to_s", F.lit(1e18)))).groupBy("match").agg(F.count("*").alias("n_words"))
