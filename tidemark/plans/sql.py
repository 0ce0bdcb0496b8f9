"""Common table expressions of plans.bindings, in SQL."""

EVENTS = """ev AS (SELECT user_id AS match, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, event_type,
  CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot' WHEN 'error' THEN 'card' WHEN 'signup' THEN 'corner' WHEN 'view' THEN 'substitution' END AS type,
  value, least(value / 500, 1.0) AS xg FROM events)"""
WORDS = r"""tok AS (SELECT conv_id AS match, turn, unnest(regexp_split_to_array(text, '\s+')) AS w, unnest(range(len(regexp_split_to_array(text, '\s+')))) AS ix FROM conversations),
wd AS (SELECT match, turn * 100000 + ix AS pos, turn * 60 + ix * CAST(0.4 AS DOUBLE) AS start, turn * 60 + ix * CAST(0.4 AS DOUBLE) + CAST(0.4 AS DOUBLE) AS "end", ' ' || w AS word FROM tok WHERE w <> '')"""
PERIODS = """pd AS (SELECT conv_id AS match, 1 AS period, min(turn) * 60.0::DOUBLE AS audio_start, max(turn) * 60.0::DOUBLE + 60 AS audio_end FROM conversations GROUP BY conv_id)"""
DAY_WINDOWS = """w AS (SELECT match, match || ':' || k AS wid, k * 7200.0::DOUBLE AS start, k * 7200.0::DOUBLE + 14400 AS "end" FROM (SELECT DISTINCT user_id AS match FROM events), (SELECT unnest(range(0, 359)) AS k))"""
SPANS = EVENTS + """,
sp AS (SELECT * FROM (SELECT match, event_id AS id, CASE WHEN event_type = 'purchase' THEN 'goal' WHEN event_type = 'click' AND value >= 50 THEN 'big_chance' WHEN event_type = 'error' THEN 'controversy' END AS question,
  t AS start, t + 3600 AS "end", event_id % 5 = 0 AS uncertain FROM ev) WHERE question IS NOT NULL)"""
VECTORS = """vs AS (SELECT CAST(label % 4 AS VARCHAR) AS question, vec_id AS seq, round(least(greatest(CAST(embedding[1] AS DOUBLE) * 0.5::DOUBLE + 0.5::DOUBLE, 0.0), 1.0), 2) AS score,
  CASE WHEN embedding[2] + embedding[1] > 0 THEN 1 ELSE 0 END AS label, CAST(1 + vec_id % 3 AS DOUBLE) AS weight, vec_id % 11 <> 0 AS sure FROM embeddings)"""
SCORED = """sw AS (SELECT source AS match, d.doc_id, (row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1) * 5.0::DOUBLE AS start, (row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1) * 5.0::DOUBLE + 20 AS "end",
  text, quality, toxic, lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
# hits of the stand-in rules: words of letters, in any case, that stand alone
HITS = r"""hw AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_\p{M}]+'), lambda x: x IN ('the', 'of', 'der', 'die', 'la')) AS ws FROM sw),
hc AS (SELECT *, CAST(len(list_filter(ws, lambda x: x = 'the')) AS BIGINT) AS goal, CAST(len(list_filter(ws, lambda x: x = 'of')) AS BIGINT) AS big_chance, CAST(len(list_filter(ws, lambda x: x IN ('der', 'die'))) AS BIGINT) AS controversy,
  CAST(len(list_filter(ws, lambda x: x = 'la')) AS BIGINT) AS card FROM hw),
h AS (SELECT *, goal + big_chance + controversy + card + length(text) - length(replace(text, '!', '')) AS intensity FROM hc)"""
