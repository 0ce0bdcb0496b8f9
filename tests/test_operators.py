"""Examples with known answers, and plain Python versions of what SQL can't say."""

import hashlib
import itertools
import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import CUES, RULES, LabelConfig, WindowConfig
from tidemark.functions import scalar
from tidemark.operators import align, calibrate, evaluate, events, intervals, labels, metrics, sampling, text, triggers, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_clocks(spark):
    row = frame(spark, [("00:47:30.500", -75.9, 3723.25)], "a string, b double, c double").select(scalar.parse_hms(F.col("a")), scalar.clock(F.col("b")), scalar.clock(F.col("c"))).first()
    assert tuple(row) == (2850.5, "-01:15", "62:03")


def test_portuguese_rules(spark):
    df = frame(spark, [("GOOOOOL do Brasil, golaço! O goleiro nada pôde fazer",), ("cartão amarelo para ele",), ("PÊNALTI! o árbitro foi ao VAR",), (None,), ("variedade de goleadas",)], "text string")
    got = [tuple(r) for r in text.rule_hits(df).select("goal", "card", "controversy", "intensity").collect()]
    assert got == [(2, 0, 0, 3), (0, 2, 0, 2), (0, 0, 3, 4), (0, 0, 0, 0), (0, 0, 0, 0)]
    pred = text.rule_predict(text.rule_hits(df), {"goal": 2}, (1, 3)).select("goal_score", "goal_pred", "intensity_pred").first()
    assert tuple(pred) == (1.0, 1, 2) and set(RULES) == {"goal", "big_chance", "controversy", "card"}


def test_cues_start_at_a_word(spark):
    words = frame(spark, [("m", i, float(i), w) for i, w in enumerate(["O", " goleiro", " fez", " goooool", " abre", " o", " placar", " na", " trave"])], "match string, pos int, start double, word string")
    got = {(r["cue"], r["t"]) for r in text.cue_hits(words, CUES).collect()}
    assert got == {("goal_call", 3.0), ("goal_score", 4.0), ("shot", 7.0)}


def test_loops(spark):
    assert len(text._cut(["gol"] * 4)) == 4
    assert len(text._cut(["gol"] * 9)) == 4
    assert len(text._cut(["vai", "brasil"] * 15)) <= 10
    assert len(text._cut([""] * 9)) == 9
    words = frame(spark, [(m, i, float(i), w) for m in (1, 2) for i, w in enumerate([" Gol!"] * (7 if m == 1 else 3))], "match int, pos int, start double, word string")
    assert sorted((r["match"], r["count"]) for r in text.cut_loops(words).groupBy("match").count().collect()) == [(1, 4), (2, 3)]


def test_segments(spark):
    w = [(0.5, 0.9, " b", 1.0), (0.1, 0.4, " ", 1.0), (0.2, 0.4, " a", 1.0)]
    seg = frame(spark, [("m", 0.0, "Legendas pela comunidade", -0.1, 0.1, w), ("m", 5.0, "x", -1.5, 0.9, w), ("m", 9.0, "ok", None, None, w)], "match string, start double, text string, avg_logprob double, no_speech_prob double, words array<struct<start:double,end:double,word:string,p:double>>")
    kept = seg.where(text.not_stock(F.col("text")) & text.not_silent(F.col("no_speech_prob"), F.col("avg_logprob")))
    assert [r["word"] for r in text.words_of_segments(kept).orderBy("pos").collect()] == [" a", " b"]


def test_windows(spark):
    words = frame(spark, [("m", t, float(t), t + 0.5, f" w{t}") for t in range(400)], "match string, pos int, start double, end double, word string")
    per = frame(spark, [("m", 1, 100.0, 100.0, 200.0)], "match string, period int, offset double, audio_start double, audio_end double")
    rows = windows.sliding_windows(words, per).orderBy("k").collect()
    assert rows[0]["start"] == 90.0 and rows[-1]["end"] <= 210 and rows[0]["n_words"] == 20 and rows[0]["t_start"] == -10
    assert rows[0]["text"].startswith("w90") and "w110" not in rows[0]["text"] and rows[0]["wid"] == "m:1:90.0"
    late = frame(spark, [("m", 1, 1000.0, 1000.0, 1030.0)], per.schema)
    assert [r["n_words"] for r in windows.sliding_windows(words, late).collect()] == [0] * 7
    assert windows.sliding_windows(words, late, WindowConfig(length=60.0)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 8), st.integers(0, 4)), max_size=25), st.integers(0, 10), st.integers(5, 40))
def test_gaps_part_triggers(rows, gap, cap):
    """Folding islands by themselves gives what folding all windows gives."""

    def fold(ws):
        out = []
        for s, e, p in sorted(ws):
            if out and s - out[-1][1] <= gap and e - out[-1][0] <= cap:
                out[-1][1] = max(out[-1][1], e)
                out[-1][2] = max(out[-1][2], p)
            else:
                out.append([s, e, p])
        return out

    ws = sorted((s, s + n, p) for s, n, p in rows)
    islands, reach = [], None
    for w in ws:
        if reach is None or w[0] - reach > gap:
            islands.append([])
        islands[-1].append(w)
        reach = max(reach or 0, w[1])
    assert fold(ws) == [t for i in islands for t in fold(i)]


def test_triggers(spark):
    pos = frame(spark, [("m", 100.0, 120.0, 0.6), ("m", 105.0, 125.0, 0.9), ("m", 300.0, 320.0, 0.7)], "match string, start double, end double, prob double")
    for found in (triggers.merge_uncapped(pos, ["match"]), triggers.merge_capped(pos, ["match"])):
        assert [(r["start"], r["end"], r["prob"], r["peak"]) for r in found.orderBy("start").collect()] == [(100.0, 125.0, 0.9, 115.0), (300.0, 320.0, 0.7, 310.0)]
    t = triggers.merge_capped(pos, ["match"]).withColumn("id", F.col("start"))
    ev = frame(spark, [("m", 1, 110.0), ("m", 2, 500.0)], "match string, e_id int, t double")
    got = triggers.event_match(t, ev, ["match"], -30.0, 30.0).first()
    assert (got["caught"], got["true_triggers"], got["precision"], got["recall"]) == (1, 1, 0.5, 0.5)
    always = frame(spark, [("m", float(s), s + 20.0, 0.5) for s in range(0, 600, 5)], pos.schema)
    assert triggers.merge_capped(always, ["match"], 30.0, 1e9).count() == 1
    capped = triggers.merge_capped(always, ["match"]).collect()
    assert len(capped) >= 5 and all(r["end"] - r["start"] <= 120 for r in capped)


def test_card_tolerance(spark):
    t = frame(spark, [("m", 1, 1000.0, 1020.0)], "match string, id int, start double, end double")
    hit = lambda e: triggers.event_match(t, frame(spark, [("m", 1, float(e))], "match string, e_id int, t double"), ["match"], -10.0, 120.0).first()["caught"]
    assert [hit(e) for e in (879, 880, 1000, 1030, 1031)] == [0, 1, 1, 1, 0]


def test_projection(spark):
    w = frame(spark, [("m", str(s), float(s), s + 20.0) for s in (80, 95, 113, 60, 40)], "match string, wid string, start double, end double")
    sp = frame(spark, [("m", "goal", 100.0, 115.0)], "match string, question string, start double, end double")
    q = frame(spark, [("goal",), ("card",)], "question string")
    got = {(r["wid"], r["question"]): r["label"] for r in intervals.project(w, sp, q).collect()}
    assert [got[s, "goal"] for s in ("80", "95", "113", "60", "40")] == [None, 1, None, 0, 0]
    assert all(got[s, "card"] == 0 for s in ("80", "95", "113", "60", "40"))


RAW_ROWS = [
    {"id": "1", "type": {"name": "Half Start"}, "period": 1, "timestamp": "00:00:00.000"}, {"id": "2", "type": {"name": "Half Start"}, "period": 1, "timestamp": "00:00:00.000"},
    {"id": "3", "type": {"name": "Shot"}, "period": 1, "timestamp": "00:10:00.000", "shot": {"statsbomb_xg": 0.5, "outcome": {"name": "Goal"}, "type": {"name": "Open Play"}}},
    {"id": "4", "type": {"name": "Shot"}, "period": 1, "timestamp": "00:20:00.000", "shot": {"statsbomb_xg": 0.1, "outcome": {"name": "Post"}, "type": {"name": "Open Play"}}},
    {"id": "5", "type": {"name": "Foul Committed"}, "period": 1, "timestamp": "00:30:00.000", "foul_committed": {"penalty": True, "card": {"name": "Yellow Card"}}},
    {"id": "6", "type": {"name": "Bad Behaviour"}, "period": 1, "timestamp": "00:31:00.000", "bad_behaviour": {"card": {"name": "Red Card"}}},
    {"id": "7", "type": {"name": "Shot"}, "period": 5, "timestamp": "00:01:00.000", "shot": {"statsbomb_xg": 0.8, "outcome": {"name": "Goal"}, "type": {"name": "Penalty"}}},
    {"id": "8", "type": {"name": "Half End"}, "period": 1, "timestamp": "00:47:30.500"}, {"id": "9", "type": {"name": "Foul Committed"}, "period": 1, "timestamp": "00:40:00.000"},
]


def test_raw_events(spark, tmp_path):
    import json

    from tidemark.sources import readers

    (tmp_path / "raw.json").write_text(json.dumps([r | {"minute": 0, "second": 0} for r in RAW_ROWS]))
    ev = events.normalize(readers.raw_events(spark, str(tmp_path / "raw.json"), "m"))
    rows = ev.collect()
    kinds = [r["type"] for r in rows]
    assert kinds.count("goal") == 1 and kinds.count("period_start") == 1 and kinds.count("card") == 2 and kinds.count("penalty_foul") == 1
    assert next(r["t"] for r in rows if r["type"] == "goal") == 600.0
    s = events.summarize(ev).first()
    assert (s["goals"], s["yellow"], s["red"], s["penalty_fouls"], s["big_chance_shots"], s["shots"], s["periods"]) == (1, 1, 1, 1, 1, 2, {1: 47.5})


def test_event_spans(spark):
    rows = [("m", "goal", 1, 100.0, 0.5, None, None), ("m", "shot", 1, 200.0, 0.4, "Saved", None), ("m", "shot", 1, 300.0, 0.05, "Post", None), ("m", "shot", 1, 310.0, 0.9, "Goal", None), ("m", "card", 2, 50.0, None, None, "Yellow Card"), ("m", "goal", 5, 5.0, 0.7, None, None), ("m", "goal", 3, 5.0, 0.7, None, None)]
    ev = frame(spark, rows, "match string, type string, period int, t double, xg double, outcome string, card string")
    per = frame(spark, [("m", 1, 1000.0), ("m", 2, 5000.0)], "match string, period int, offset double")
    got = {(r["question"], r["start"], r["end"]) for r in labels.event_spans(ev, per).collect()}
    assert got == {("goal", 1097.0, 1112.0), ("big_chance", 1197.0, 1208.0), ("big_chance", 1297.0, 1308.0), ("card_search", 5050.0, 5170.0)}


def test_label_merge(spark):
    ev = frame(spark, [("m", "goal", 100.0, 115.0), ("m", "card_search", 300.0, 420.0), ("m", "card_search", 900.0, 1020.0), ("m", "big_chance", 600.0, 611.0)], "match string, question string, start double, end double")
    te = frame(spark, [("m", "goal", 110.0, 150.0, False, ""), ("m", "goal", 700.0, 710.0, False, "x"), ("m", "card", 330.0, 340.0, False, ""), ("m", "card", 500.0, 510.0, False, ""), ("m", "card", 950.0, 960.0, True, ""), ("m", "controversy", 800.0, 810.0, False, ""), ("m", "controversy", 850.0, 860.0, True, "")], "match string, question string, start double, end double, uncertain boolean, note string")
    pos, ign, log = labels.merge_spans(ev, te)
    assert {(r["question"], r["start"]) for r in pos.collect()} == {("goal", 100.0), ("big_chance", 600.0), ("card", 330.0), ("controversy", 800.0)}
    assert {(r["question"], r["start"]) for r in ign.collect()} == {("goal", 110.0), ("goal", 700.0), ("card", 500.0), ("card", 950.0), ("card", 900.0), ("controversy", 850.0)}
    assert {(r["kind"], r["start"]) for r in log.collect()} == {("teacher_goal_without_event", 700.0), ("teacher_card_outside_event_region", 500.0), ("event_card_not_found_by_teacher", 900.0), ("event_big_chance_without_teacher", 600.0)}
    w = frame(spark, [("m", "a", 100.0, 120.0), ("m", "b", 130.0, 150.0), ("m", "c", 2000.0, 2020.0)], "match string, wid string, start double, end double")
    blocks = frame(spark, [("m", "B1", 90.0, 110.0), ("m", "B2", 110.0, 130.0), ("m", "B3", 130.0, 150.0)], "match string, block string, start double, end double")
    levels = frame(spark, [("m", "B1", 2, False), ("m", "B2", 2, True), ("m", "B3", 1, True)], "match string, block string, level int, uncertain boolean")
    got = {r["wid"]: r for r in labels.merge_labels(w, ev, te, blocks, levels)[0].collect()}
    assert (got["a"]["goal"], got["a"]["intensity"]) == (1, 2) and got["b"]["goal"] is None and got["b"]["intensity"] is None
    assert got["c"]["goal"] == 0 and got["c"]["card"] is None and got["c"]["big_chance"] is None
    assert LabelConfig().block_overlap == 5.0


def test_metrics(spark):
    def of(scores, ys):
        return frame(spark, [("q", i, float(p), y) for i, (p, y) in enumerate(zip(scores, ys, strict=True))], "q string, seq long, score double, label int")

    auc = lambda s, y: metrics.roc_auc(of(s, y), ["q"]).first()["auc"]
    assert auc([0.9, 0.8, 0.1, 0.2], [1, 1, 0, 0]) == 1 and auc([0.5] * 4, [1, 0, 1, 0]) == 0.5 and auc([0.5], [1]) is None
    ap = lambda s, y: metrics.average_precision(of(s, y), ["q"]).first()["ap"]
    assert ap([0.9, 0.8, 0.7], [1, 0, 1]) == pytest.approx((1 + 2 / 3) / 2) and ap([0.1], [0]) is None and ap([0.5, 0.5], [0, 1]) == 0.5
    p = metrics.prf(of([1, 1, 0, 0], [1, 0, 1, 0]), ["q"], F.col("score").cast("int"), F.col("label")).first()
    assert (p["precision"], p["recall"], p["tp"]) == (0.5, 0.5, 1.0)
    e = of([0.9] * 10, [1] * 9 + [0]).withColumnRenamed("score", "prob")
    assert metrics.ece(e, ["q"]).first()["ece"] == pytest.approx(0)
    bins = metrics.reliability(of([0.3, 0.7, 1.0, 0.0, 0.1 * 3], [1, 0, 1, 0, 1]).withColumnRenamed("score", "prob"), ["q"]).collect()
    assert sum(r["n"] for r in bins) == 5 and max(r["bin"] for r in bins) == 9


def test_running_sum_over_cells(spark):
    r = random.Random(2)
    rows = [("q", i, r.choice([0.0, 0.2, 0.2004, 0.2005, 0.5, 1.0]), r.randint(0, 1)) for i in range(3000)]
    old, metrics.SEQ_CELL = metrics.SEQ_CELL, 70
    try:
        got = {x["seq"]: x["n"] for x in metrics.running(frame(spark, rows, "q string, seq long, score double, label int"), ["q"], F.col("label"), "n").collect()}
    finally:
        metrics.SEQ_CELL = old
    total, want = 0, {}
    for _, i, _, y in sorted(rows, key=lambda x: (-x[2], x[1])):
        total += y
        want[i] = total
    assert got == want


def test_calibration(spark):
    r = random.Random(0)
    rows = []
    for _ in range(2000):
        z = r.gauss(0, 2)
        rows.append(("q", 1 / (1 + 2.718281828 ** (-2.5 * z)), int(r.random() < 1 / (1 + 2.718281828**-z))))
    df = frame(spark, rows, "question string, prob double, label int")
    fits = calibrate.fit_platt(df, "question")
    assert fits["q"][0] == pytest.approx(0.4, abs=0.06)
    before, after = (metrics.ece(d, ["question"]).first()["ece"] for d in (df, calibrate.with_platt(df, "question", fits)))
    assert after < before / 2
    th = calibrate.best_threshold(frame(spark, [("q", 0.1, 0), ("q", 0.4, 0), ("q", 0.6, 1), ("q", 0.9, 1), ("q", 0.5, None)], df.schema), ["question"]).first()
    assert 0.4 < th["threshold"] <= 0.6 and th["f1"] == 1.0


def test_alignment_recovers_an_offset(spark):
    r = random.Random(5)
    true, anchors, hits = 3725.0, [], []
    for i in range(12):
        t = r.uniform(0, 2800)
        anchors.append(("m", 1, i, "goal" if i < 3 else "shot", t))
        hits.append(("m", "goal_call" if i < 3 else "shot", true + t + (2.0 if i < 3 else 1.0) + r.gauss(0, 0.5)))
    hits += [("m", "shot", r.uniform(2500, 7000)) for _ in range(40)]
    a = frame(spark, anchors, "match string, period int, anchor int, kind string, t double")
    h = frame(spark, hits, "match string, cue string, t double")
    cues = align.cue_table(spark)
    found = align.fit_offset(a, h, cues, frame(spark, [("m", 1, true + 400, 1200.0)], "match string, period int, center double, radius double"))
    assert abs(found.first()["offset"] - true) < 3
    res = align.loo_residuals(a, h, cues, found, radius=8.0).collect()
    assert all(abs(x["loo_residual"]) < 3 for x in res if x["kind"] == "goal")
    # one anchor less, fitted again
    for x in res[:3]:
        again = align.fit_offset(a.where(F.col("anchor") != x["anchor"]), h, cues, frame(spark, [("m", 1, found.first()["offset"], 8.0)], "match string, period int, center double, radius double")).first()
        assert again["offset"] == x["loo_offset"]


def test_periods_follow_one_another(spark):
    a = frame(spark, [("m", 1, 1, "goal", 100.0), ("m", 2, 1, "goal", 200.0)], "match string, period int, anchor int, kind string, t double")
    h = frame(spark, [("m", "goal_call", 1302.0), ("m", "goal_call", 5002.0)], "match string, cue string, t double")
    ends = frame(spark, [("m", 1, 2800.0), ("m", 2, 2900.0), ("m", 5, 10.0)], "match string, period int, t double")
    got = {x["period"]: x for x in align.align(a, h, align.cue_table(spark), ends, frame(spark, [("m", 1000.0)], "match string, hint double")).collect()}
    assert got[1]["offset"] == 1200.0 and got[1]["audio_end"] == 4000.0 and got[2]["search_center"] == 4900.0 and got[2]["offset"] == 4800.0 and set(got) == {1, 2}


def test_nearest_ties_go_to_the_earlier(spark):
    p = frame(spark, [("m", i, float(t)) for i, t in enumerate((0, 10, 15, 20, 99))], "match string, id int, t double")
    h = frame(spark, [("m", 10.0), ("m", 20.0), ("m", 20.0)], "match string, t double")
    assert [x["near"] for x in align.nearest(p, h, ["match"]).orderBy("id").collect()] == [10.0, 10.0, 10.0, 20.0, 20.0]


def test_samples(spark):
    rows = [("m", str(i), i * 5.0, 1 if i % 50 else 0, ("positive", "keyword", "random")[i % 3]) for i in range(600)]
    got = sampling.min_gap_sample(frame(spark, rows, "match string, wid string, start double, n_words int, stratum string")).collect()
    starts = sorted(x["start"] for x in got)
    assert all(y - x >= 10 for x, y in itertools.pairwise(starts))
    assert {s: sum(x["stratum"] == s for x in got) for s in ("positive", "keyword", "random")} == {"positive": 60, "keyword": 40, "random": 50}
    assert sorted(x["idx"] for x in got) == list(range(150)) and not {x["wid"] for x in got} & {r[1] for r in rows if not r[3]}
    long_ = frame(spark, [(str(i), "goal", None if i % 7 == 0 else int(i < 20)) for i in range(3000)], "wid string, question string, label int")
    kept = sampling.cap_negatives(long_, ratio=10.0).collect()
    pos = sum(x["label"] == 1 for x in kept)
    assert pos == 17 and 120 <= sum(x["label"] == 0 for x in kept) <= 220
    more = sampling.upsample(long_, 30).collect()
    assert len(more) == 13 and len({x["wid"] for x in more}) == 13 and all(int(x["source_wid"]) < 20 for x in more)
    cases = sampling.training_cases(long_, long_.select("wid", F.lit("t").alias("text")), min_pos=30).collect()
    assert sum(x["gold"].get("goal") == 1 for x in cases) == 30


def test_windows_of_panes_are_those_of_words(spark, monkeypatch):
    """Chunks cut anywhere, words out of order, on the bounds and outside, empty panes, and a length of no whole number of strides."""
    r = random.Random(9)
    words = [(m, i, round(r.uniform(-20, 220), 1) if i % 5 else float(5 * r.randint(0, 40)), f" {m}{i}") for m in "ab" for i in range(150)]
    periods = [("a", 1, 3.0, 5.0, 90.0), ("a", 2, 100.0, 110.5, 200.0), ("b", 1, 0.0, 0.0, 200.0), ("b", 2, 0.0, 0.0, -30.0), ("quiet", 1, 0.0, 0.0, 40.0)]
    w = frame(spark, words, "match string, pos int, start double, word string")
    p = frame(spark, periods, "match string, period int, offset double, audio_start double, audio_end double")
    monkeypatch.setattr(windows, "CHUNK", 3)
    for cfg in (WindowConfig(), WindowConfig(20.0, 20.0, 10.0), WindowConfig(12.0, 5.0, 10.0)):
        got = {(x["match"], x["period"], x["start"]): (x["text"], x["n_words"]) for x in windows.sliding_windows(w, p, cfg).collect()}
        want = {}
        for m, n, _, a, b in periods:
            for k in range(int((b + 10 - cfg.length - (a - 10) + 1e-9) // cfg.stride) + 1):
                start = a - 10 + k * cfg.stride
                said = [x[3] for x in words if x[0] == m and start <= x[2] < start + cfg.length]
                want[m, n, start] = ("".join(said).strip(), len(said))
        assert got == want and got


def test_min_gap_draws_are_the_greedy_ones(spark):
    """Against the plain loop, with crowded matches that need more than their first pool, ties and a stratum nobody asks for."""
    r = random.Random(4)
    rows = [(m, f"{i:04}", float(r.randint(0, span)), int(r.random() < 0.95), r.choice(["positive", "keyword", "random", "other"])) for m, n, span in (("a", 900, 9000), ("crowded", 900, 60), ("b", 40, 4000)) for i in range(n)]
    got = sampling.min_gap_sample(frame(spark, rows, "match string, wid string, start double, n_words int, stratum string"), {"positive": 30, "keyword": 6, "random": 12}, pool=2).collect()
    rank = lambda x, seed: int(hashlib.md5(f"{seed}:{x[0]}:{x[1]}".encode()).hexdigest()[:13], 16)
    want = {}
    for m in ("a", "crowded", "b"):
        near = []
        for name, target in (("positive", 30), ("keyword", 6), ("random", 12)):
            pool = sorted((x for x in rows if x[0] == m and x[3] and x[4] == name), key=lambda x: (rank(x, 0), x[1]))
            found = []
            for x in pool:
                if len(found) < target and all(abs(x[2] - y) >= 10 for y in near):
                    found.append(x)
                    near.append(x[2])
            want |= {x[:2]: (name, math.floor(len(pool) / len(found) * 1000 + 0.5) / 1000, len(pool)) for x in found}
    assert {(x["match"], x["wid"]): (x["stratum"], x["weight"], x["stratum_size"]) for x in got} == want
    for m in ("a", "crowded", "b"):
        some = sorted((x for x in got if x["match"] == m), key=lambda x: x["idx"])
        assert [x["idx"] for x in some] == list(range(len(some))) and [x["wid"] for x in some] == sorted((x["wid"] for x in some), key=lambda w: (rank((m, w), 1), w))


def test_event_metrics(spark):
    w = frame(spark, [("m", f"w{i}", i * 100.0, i * 100.0 + 20) for i in range(10)], "match string, wid string, start double, end double")
    scores = frame(spark, [(m, f"w{i}", q, 0.9, int(i in on)) for m, q, on in (("a", "goal", {1, 5, 7}), ("b", "goal", {1}), ("a", "card", {3}), ("b", "card", set())) for i in range(10)], "method string, wid string, question string, score double, pred int")
    truth = frame(spark, [("m", "goal", 110.0), ("m", "goal", 900.0), ("m", "card", 200.0)], "match string, question string, t double")
    ignored = frame(spark, [("m", "goal", 730.0)], truth.schema)
    got = {(r["method"], r["question"]): r for r in evaluate.event_metrics(scores, w, truth, ignored).collect()}
    tell = lambda *k: tuple(got[k][c] for c in ("events", "caught", "triggers", "true_triggers"))
    assert tell("a", "goal") == (2, 1, 2, 1) and tell("b", "goal") == (2, 1, 1, 1) and tell("a", "card") == (1, 1, 1, 1) and tell("b", "card") == (1, 0, 0, 0)
    assert got["a", "goal"]["minutes"] == pytest.approx(1.0) and got["b", "card"]["precision"] is None


def test_cells_fit_the_intervals(spark):
    long_ = frame(spark, [("m", f"w{i}", i * 7200.0, i * 7200.0 + 14400) for i in range(200)], "match string, wid string, start double, end double")
    spans = frame(spark, [("m", "goal", i * 9000.0, i * 9000.0 + 3600) for i in range(100)] + [("m", "goal", 0.0, 900_000.0)], "match string, question string, start double, end double")
    cell = intervals.cell_for(long_, spans, 1800.0)
    rows = long_.select(F.explode(intervals._cells(F.col("start") - 1800, F.col("end") + 1800, cell))).count()
    assert rows <= 1.6 * 200
    want = {(w, s) for w, ws, we in ((r["wid"], r["start"], r["end"]) for r in long_.collect()) for s, e in ((r["start"], r["end"]) for r in spans.collect()) if s <= we + 1800 and e >= ws - 1800}
    for c in (None, 100.0, 1e6):
        pairs = intervals.near_pairs(long_, spans, ["match"], 1800.0, c).select("wid", "r_start", "r_end").collect()
        assert {(x["wid"], x["r_start"]) for x in pairs} == want and len(pairs) == len({(x["wid"], x["r_start"], x["r_end"]) for x in pairs})
    none = spans.limit(0)
    assert intervals.near_pairs(long_, none, ["match"]).count() == 0 == intervals.near_pairs(long_.limit(0), spans, ["match"]).count()


def test_ignored_spans_in_one_pass(spark):
    w = frame(spark, [("m", f"w{i}", i * 5.0, i * 5.0 + 20) for i in range(30)], "match string, wid string, start double, end double")
    pos = frame(spark, [("m", "goal", 40.0, 50.0)], "match string, question string, start double, end double")
    ign = frame(spark, [("m", "goal", 45.0, 90.0), ("m", "card", 120.0, 130.0)], "match string, question string, start double, end double")
    asked = frame(spark, [("goal",), ("card",)], "question string")
    one = intervals.project(w, pos, asked, ignored=ign)
    two = labels.ignore_overlay(intervals.project(w, pos, asked), w, ign)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_events_are_numbered_as_they_were_listed(spark):
    rows = [("m", 3, "c", ("Foul Committed",), 1, "00:10:00.000"), ("m", 2, "b", ("Offside",), 1, "00:10:00.000"), ("m", 1, "a", ("Half Start",), 1, "00:00:00.000"), ("m", 9, "d", ("Half End",), 1, "00:45:00.000"), ("m", 4, "e", ("Substitution",), 1, None)]
    raw = frame(spark, rows, "match string, index int, id string, type struct<name:string>, period int, timestamp string")
    full = raw.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("minute", "int"), ("second", "int"), ("team", "struct<name:string>"), ("player", "struct<name:string>"), ("shot", "struct<statsbomb_xg:double,outcome:struct<name:string>,type:struct<name:string>>"), ("bad_behaviour", "struct<card:struct<name:string>>"), ("pass", "struct<type:struct<name:string>>"))])
    full = full.withColumn("foul_committed", F.when(F.col("id") == "c", F.struct(F.lit(True).alias("penalty"), F.struct(F.lit("Red Card").alias("name")).alias("card"))))
    got = [(x["seq"], x["type"]) for x in events.normalize(full).orderBy("seq").collect()]
    assert got == [(1, "period_start"), (2, "offside"), (3, "penalty_foul"), (4, "card"), (5, "period_end"), (6, "substitution")]


def test_missing_labels_are_an_error(spark):
    scores = frame(spark, [("a", 0.5), ("b", 0.2)], "wid string, score double")
    some = frame(spark, [("a", 1)], "wid string, label int")
    with pytest.raises(KeyError):
        evaluate.with_all_labels(scores, some)
    assert evaluate.with_all_labels(scores.where("wid = 'a'"), some).count() == 1


def test_tolerance_is_mirrored_for_ignored_moments(spark):
    t = frame(spark, [("m", 1, 100.0, 120.0), ("m", 2, 1000.0, 1020.0)], "match string, id int, start double, end double")
    # an event is caught from start - 120 to end + 10; an ignored one counts from start - 10 to end + 120
    at = lambda *x: frame(spark, [("m", i, v) for i, v in enumerate(x)], "match string, e_id int, t double")
    caught = triggers.hits(t, at(-15.0, 125.0), ["match"], -10.0, 120.0).collect()
    assert {x["e_id"] for x in caught} == {0, 1}
    assert {x["id"] for x in triggers.drop_ignored(t, at(-500.0), at(230.0), ["match"], -10.0, 120.0).collect()} == {2}
    assert {x["id"] for x in triggers.drop_ignored(t, at(-500.0), at(-5.0), ["match"], -10.0, 120.0).collect()} == {1, 2}


def test_long_triggers_are_few_rows_and_meet_all_moments(spark):
    t = frame(spark, [("m", i, 50000.0 * i, 50000.0 * i + 40000) for i in range(20)], "match string, id int, start double, end double")
    assert triggers.by_cell(t, -1800.0, 7200.0, triggers.cell_of(t, -1800.0, 7200.0)).count() <= 40
    at = frame(spark, [("m", i, 50000.0 * i + x) for i, x in enumerate([-7200.0, -7201.0, 41800.0, 41801.0, 20000.0])], "match string, e_id int, t double")
    assert sorted(x["id"] for x in triggers.hits(t, at, ["match"], -1800.0, 7200.0).collect()) == [0, 2, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_event_metrics_one_by_one(spark, seed):
    import random

    r = random.Random(seed)
    w = [(f"{m}{i}", m, 60.0 * i, 60.0 * i + r.choice([20.0, 100.0, 300.0])) for m in "ab" for i in range(60)]
    scores = [(method, wid, q, 0.5, int(r.random() < 0.3)) for method in ("x", "y") for wid, *_ in w for q in ("goal", "card")]
    points = lambda n: list({(r.choice("abc"), r.choice(["goal", "card", "other"]), float(r.randrange(0, 4000))) for _ in range(n)})
    truth, ignored = points(60), points(80)
    cfg = evaluate.TriggerConfig(gap=30.0, max_len=240.0, tolerance={"goal": (-30.0, 30.0), "card": (-10.0, 120.0)})
    windows_ = frame(spark, w, "wid string, match string, start double, end double")
    pos = frame(spark, scores, "method string, wid string, question string, score double, pred int")
    moments = lambda rows: frame(spark, rows, "match string, question string, t double")
    got = {(x["method"], x["question"]): x for x in evaluate.event_metrics(pos, windows_, moments(truth), moments(ignored), cfg).collect()}
    made = triggers.merge_capped(pos.where("pred = 1").join(windows_, "wid").selectExpr("match", "method", "question", "start", "end", "score prob"), ["match", "method", "question"], 30.0, 240.0).collect()
    assert len(got) == 4
    for (method, q), x in got.items():
        lo, hi = cfg.tolerance[q]
        own = lambda rows, m: [t for a, b, t in rows if a == m and b == q]  # noqa: B023,E731
        kept = [g for g in made if g["method"] == method and g["question"] == q]
        kept = [g for g in kept if any(g["start"] + lo <= t <= g["end"] + hi for t in own(truth, g["match"])) or not any(g["start"] + lo <= t <= g["end"] + hi for t in own(ignored, g["match"]))]
        meets = lambda g, t: g["start"] - hi <= t <= g["end"] - lo  # noqa: B023,E731
        assert x["triggers"] == len(kept) and x["events"] == sum(b == q for _, b, _ in truth)
        assert x["true_triggers"] == sum(any(meets(g, t) for t in own(truth, g["match"])) for g in kept)
        assert x["caught"] == sum(any(meets(g, t) for g in kept if g["match"] == m) for m, b, t in truth if b == q)
