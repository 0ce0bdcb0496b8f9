import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import triggers
from tidemark.sources.shared import new_path
from tidemark.sources.sinks import TimelineSink
from tidemark.streaming import highlights, paced, replay, scoring
from tidemark.streaming.progress import Progress

WINDOWS = "match string, wid string, start double, end double, goal double, card double"
TH = {"goal": 0.8, "card": 0.95}


def windows(spark, seed=3):
    r = random.Random(seed)
    rows = [(m, f"{m}:{i}", i * 5.0, i * 5.0 + 20, round(r.random(), 2), round(r.random(), 2)) for m in ("a", "b", "c") for i in range(150) if m != "c" or i % 40 < 4]
    r.shuffle(rows)
    return spark.createDataFrame(rows, WINDOWS)


def batch(df):
    """What the fold of triggers gives."""
    out = []
    for q, th in TH.items():
        pos = df.where(df[q] >= th).select("match", "start", "end", df[q].alias("prob"))
        out += [(x["match"], q, x["start"], x["end"], x["prob"]) for x in triggers.merge_capped(pos, ["match"]).collect()]
    return sorted(out)


def told(df):
    return sorted((x["match"], x["question"], x["start"], x["end"], x["peak_prob"]) for x in df.collect())


def test_stream_gives_the_batch_triggers(spark):
    df = windows(spark)
    with Progress(spark) as seen:
        got = replay.run(df, list(TH), TH, slices=3, name="counted")
    assert told(got) == batch(df)
    rows = seen.batches().where("query = 'counted'").collect()
    assert sum(r["rows"] for r in rows) == df.count() + 1 and len(rows) > 2 and all(r["trigger_ms"] > 0 for r in rows)
    took = seen.latencies().where("query = 'counted'").first()
    assert took["n"] == len(rows) and min(r["trigger_ms"] for r in rows) <= took["p50"] <= max(r["trigger_ms"] for r in rows)


def test_no_windows(spark):
    assert replay.run(windows(spark).limit(0), list(TH), TH).collect() == []


def test_a_stream_goes_on_from_its_checkpoint(spark):
    """Stopped after half of the windows, with open highlights in state, and started anew: each highlight comes once."""
    df, top = windows(spark, 5), new_path(spark, "restart")
    rows = df.withColumn("at", F.timestamp_seconds("end")).withColumn("latency_ms", F.lit(None).cast("double"))
    end = rows.limit(1).withColumn("at", F.timestamp_seconds(F.lit(100_000.0))).withColumn("match", F.lit("end"))

    def go(part):
        part.write.mode("append").parquet(f"{top}/in")
        found = highlights.highlights(highlights.long_scores(spark.readStream.schema(rows.schema).parquet(f"{top}/in"), list(TH)), TH, late="0 seconds")
        found.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(found.schema).parquet(f"{top}/out").where("match <> 'end'")

    with replay.rocks(spark):
        first = told(go(rows.where("end <= 400")))
        assert first and set(first) < set(batch(df))
        assert told(go(rows.where("end > 400").union(end))) == batch(df)


def test_scorers_in_the_stream_give_the_rows_of_the_batch(spark):
    rows = [("a", f"a:{i}", i * 5.0, i * 5.0 + 20, "Goal goal" if i in (3, 4) else None if i == 7 else "quiet") for i in range(20)]
    w = spark.createDataFrame(rows, "match string, wid string, start double, end double, text string")
    rules = {"goal": r"\bgoal\b"}
    run_scorer = lambda x: scoring.score(x, lambda: scoring.KeywordScorer(rules, {"goal": 2}), ["goal"])
    plain = scoring.keyword_scores(w, rules, {"goal": 2})
    assert sorted(map(str, run_scorer(w).select(*w.columns, "goal").collect())) == sorted(map(str, plain.select(*w.columns, "goal").collect()))
    saved = plain.select("wid", "goal").where("wid <> 'a:9'")
    want = [("a", "goal", 15.0, 40.0, 1.0)]
    assert told(replay.run(w, ["goal"], {"goal": 0.5}, score=run_scorer)) == want
    assert told(replay.run(w.drop("text"), ["goal"], {"goal": 0.5}, score=lambda x: scoring.saved_scores(x, saved, ["goal"]))) == want
    got = json.loads(replay.timeline(w, ["goal"], {"goal": 0.5}, "goal", score=run_scorer).first()["json"])
    assert [(h["start"], h["end"], h["peak_wid"]) for h in got["highlights"]] == [(15.0, 40.0, "a:3")] and got["highlights"][0]["first_latency_ms"] > 0
    assert got["thresholds"] == {"goal": 0.5} and [x["t"] for x in got["trace"]] == [i * 5.0 + 20 for i in range(20)] and got["latency_ms"]["n"] == 20 and got["latency_ms"]["p90"] > 0


def test_a_batch_sent_twice_changes_nothing(spark):
    sink = TimelineSink(new_path(spark, "twice"), {"goal": 0.5})
    assert sink.read(spark).collect() == []
    part = lambda *rows: spark.createDataFrame(list(rows), highlights.HIGHLIGHT)
    one = part(("highlight", "a", "goal", 5.0, 30.0, 0.9, "w1", 2.0), ("trace", "a", "goal", 5.0, 25.0, 0.9, "w1", 2.0), ("trace", "b", "goal", 0.0, 20.0, None, "w9", None))
    two = part(("trace", "a", "goal", 10.0, 30.0, 0.1, "w2", 4.0))
    seen = []
    for rows, n in ((one, 0), (one, 0), (two, 1), (one, 0), (two, 1)):
        sink.take(rows, n)
        seen.append({x["match"]: json.loads(x["json"]) for x in sink.read(spark).collect()})
    assert seen[0] == seen[1] and seen[2] == seen[3] == seen[4] != seen[1]
    assert [x["score"] for x in seen[4]["a"]["trace"]] == [0.9, 0.1] and len(seen[4]["a"]["highlights"]) == 1 and seen[4]["a"]["latency_ms"] == {"n": 2, "p50": 3.0, "p90": 2.0}
    assert "latency_ms" not in seen[4]["b"] and seen[4]["b"]["highlights"] == []


def test_paced_replay_keeps_time_and_goes_on_after_a_stop(spark):
    df = spark.range(12).select(F.concat(F.lit("w"), "id").alias("wid"), (F.col("id") * 5.0).alias("end"))
    top = paced.lay_out(df, "paced-test")
    stream = paced.stream(spark, top, df, speed=10.0)
    began = time.time()
    query = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(processingTime="200 milliseconds").start()
    while not query.recentProgress or not any(p.numInputRows for p in query.recentProgress):
        time.sleep(0.2)
    query.stop()
    early = spark.read.parquet(f"{top}/out").agg(F.max("end")).first()[0]
    assert early <= (time.time() - began) * 10.0 + 5.0  # nothing before it is due
    got = replay.collected(stream, top).collect()
    assert time.time() - began >= 5.4  # 55 s of windows at ten times their speed
    assert sorted(x["wid"] for x in got) == sorted(f"w{i}" for i in range(12))
    assert replay.collected(paced.stream(spark, paced.lay_out(df.limit(0), "none"), df), paced.lay_out(df.limit(0), "none")).collect() == []


def test_settings_of_the_state_store_go_back(spark):
    key = next(iter(replay._STATE))
    before = spark.conf.get(key)
    with pytest.raises(ValueError), replay.rocks(spark):
        assert "RocksDB" in spark.conf.get(key)
        raise ValueError
    assert spark.conf.get(key) == before
