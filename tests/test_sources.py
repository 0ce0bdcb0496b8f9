import json
import os
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import config
from tidemark.sources import readers, sinks


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"wid": "a", "n_words": 3}\n\n   \nnot json\n{"wid": "b", "start": 1.5, "other": 1}\n')
    path = str(tmp_path / "a.jsonl")
    assert sorted((r["wid"], r["n_words"], r["start"]) for r in readers.jsonl(spark, path, readers.WINDOW).collect()) == [("a", 3, None), ("b", None, 1.5)]
    assert [r["_corrupt_record"] for r in readers.jsonl(spark, path, readers.WINDOW, bad=True).where("_corrupt_record is not null").collect()] == ["not json"]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), readers.WINDOW, missing_ok=True).count() == 0


def test_registry(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text(yaml.safe_dump({"matches": [{"id": "a", "split": "train"}, {"id": "b", "split": "test"}], "spares": [{"id": "c"}]}))
    rows = readers.load_registry(spark, str(tmp_path / "m.yaml"), include_spares=True)
    assert {(r["id"], r["split"]) for r in rows.collect()} == {("a", "train"), ("b", "test"), ("c", "spare")}
    assert readers.get_match(rows, "b")["split"] == "test"
    with pytest.raises(KeyError):
        readers.get_match(rows, "z")


def test_teacher(spark):
    lines = [{"kind": "span", "q": "goal", "start": 1, "end": 2.5, "uncertain": True, "note": "n"}, {"kind": "span", "q": "goal", "start": 3, "end": 2}, {"kind": "span", "q": "other", "start": 1, "end": 2}, {"kind": "span", "q": "card", "start": "1", "end": 2},
             {"kind": "intensity", "block": "B1", "level": "calm"}, {"kind": "intensity", "block": "B1", "level": "peak", "uncertain": True}, {"kind": "intensity", "block": "B1", "level": "loud"}, {"kind": "x"}]
    rows = [("m", i + 1, json.dumps(x)) for i, x in enumerate(lines)] + [("m", 9, "{oops"), ("m", 10, "  ")]
    spans, levels, problems = readers.teacher(readers.teacher_lines(spark.createDataFrame(rows, "match string, line int, value string")))
    assert [tuple(r) for r in spans.collect()] == [("m", "goal", 1.0, 2.5, True, "n")]
    assert [tuple(r) for r in levels.collect()] == [("m", "B1", 2, True)]
    assert sorted(r["detail"] for r in problems.collect()) == ["line 2: bad span", "line 3: bad span", "line 4: bad span", "line 7: bad intensity", "line 8: unknown kind", "line 9: not JSON"]


def test_captions(spark):
    rows = [("m", [(0, 1000, [("a",)]), (2000, None, [(" ",)]), (5000, None, None), (7000, None, [(None,), ("b",)])])]
    df = spark.createDataFrame(rows, "match string, events array<struct<tStartMs:long,dDurationMs:long,segs:array<struct<utf8:string>>>>")
    assert [(r["start"], r["end"]) for r in readers.captions(df).orderBy("seq").collect()] == [(0.0, 1.0), (7.0, 7.0)]


def test_speech_window(spark):
    hints = spark.createDataFrame([("a", 2000.0, None), ("b", 1000.0, 5000.0), ("c", None, None), ("d", 10.0, None)], "match string, hint double, duration double")
    ev = spark.createDataFrame([("a", 1), ("a", 3), ("a", 5), ("b", 2), ("c", 1)], "match string, period int")
    got = {r["match"]: (r["from_s"], r["to_s"]) for r in readers.speech_window(hints, ev).collect()}
    assert got == {"a": (500.0, 2000.0 + 210 * 60), "b": (0.0, 5000.0), "c": (0.0, None), "d": (0.0, None)}


def test_upsert_and_frozen(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "idx int, v string, ts int")
    sinks.save_upsert(spark, rows((1, "a", 1), (2, "b", 5)), path, ["idx"])
    sinks.save_upsert(spark, rows((1, "c", 1), (2, "old", 4), (3, "d", 1)), path, ["idx"])
    assert sorted(tuple(r) for r in sinks.read_upsert(spark, path).collect()) == [(1, "c", 1), (2, "b", 5), (3, "d", 1)]
    sinks.write_table(rows((1, "a", 1), (1, "b", 2)), str(tmp_path / "f"), ["v"], frozen=True)
    with pytest.raises(AnalysisException):
        sinks.write_table(rows((1, "a", 1)), str(tmp_path / "f"), ["v"], frozen=True)
    sinks.write_table(rows((9, "b", 2)), str(tmp_path / "f"), ["v"])
    assert sorted((r["idx"], r["v"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [(1, "a"), (9, "b")]


def test_blind_review_items(spark):
    cand = spark.createDataFrame([("m", "card", 130.04, ["rules"])], "match string, question string, t double, sources array<string>")
    per = spark.createDataFrame([("m", 1, 100.0, 100.0), ("m", 2, 500.0, 500.0)], "match string, period int, offset double, audio_start double")
    words = spark.createDataFrame([("m", i, float(i), f" w{i}") for i in range(300)], "match string, pos int, start double, word string")
    row = sinks.review_items(cand, per, words).first()
    assert row["wid"] == "review:card:130.0" and row["clock"] == "P1 00:30" and row["text"].startswith("w110") and row["prev_text"].endswith("w109")
    assert "sources" not in sinks.blind(sinks.review_items(cand, per, words)).columns


def test_report(spark):
    w = [{"method": "rules", "question": "goal", "f1": 0.5, "ap": None}]
    e = [{"method": "rules", "question": "goal", "caught": 3, "events": 6, "true_triggers": 3, "triggers": 17, "minutes": 12.1}]
    out = sinks.report(w, e, ["goal"])
    assert "| rules | 0.50 (–) |" in out and "3/6 · 3/17 · 12" in out
    frames = [spark.createDataFrame(x) for x in ([{"method": "rules", "question": "goal", "f1": 0.5}], [{"method": "rules", "question": "goal", "caught": 3}])]
    assert json.loads(sinks.results_json(*frames).first()["json"])["event"]["goal"]["caught"] == 3
    w[0]["positives"] = 7
    more = sinks.report(w, e, ["goal"], [{"method": "rules", "n": 9, "accuracy": 0.5, "mae": 0.25}], [{"method": "rules", "question": "pooled", "ece": 0.125}], [{"name": "stream", "n": 3, "p50": 1.0, "p90": 2.0}])
    assert "Gold positives: goal 7" in more and "| rules | 9 | 0.50 | 0.25 |" in more and "| rules | – | 0.125 |" in more and "| stream | 3 | 1.0 | 2.0 |" in more


def test_labels_and_predictions_by_folder(spark, tmp_path):
    for split, wid, y in (("train", "a", 1), ("val", "b", None), ("test", "c", 0)):
        (tmp_path / "labels" / f"split={split}").mkdir(parents=True)
        (tmp_path / "labels" / f"split={split}" / "x.jsonl").write_text(json.dumps({"wid": wid, "match": "m", "labels": {"goal": y, "intensity": 2}}) + "\n")
    got = readers.labels_of(spark, str(tmp_path / "labels"), ["train", "val", "none"])
    assert {(r["wid"], r["split"], r["label"]) for r in got.where("question = 'goal'").collect()} == {("a", "train", 1), ("b", "val", None)} and got.count() == 10
    (tmp_path / "pred" / "tag=ft").mkdir(parents=True)
    (tmp_path / "pred" / "tag=ft" / "x.jsonl").write_text(json.dumps({"wid": "a", "answers": {"goal": {"noul": 0.7}}}) + "\n")
    assert readers.predictions_of(spark, str(tmp_path / "pred"), "ft").first()["answers"]["goal"]["noul"] == 0.7
    assert readers.predictions_of(spark, str(tmp_path / "pred"), "other").count() == 0


def test_windows_of_splits_and_questions(spark):
    w = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "wid string, match string")
    m = readers.registry(spark, [{"id": "a", "split": "train"}, {"id": "b", "split": "val"}, {"id": "c", "split": "test"}])
    assert [r["wid"] for r in readers.windows_for(w, m, ["train", "val"]).orderBy("wid").collect()] == ["1", "2"]
    assert [r["wid"] for r in readers.windows_for(w, m, ["train", "val"], "b").collect()] == ["2"]
    texts = {lang: {q: ("ask", "if") for q in ("goal", "big_chance", "controversy", "card", "intensity")} for lang in ("en", "pt")}
    assert readers.question_dim(spark, texts, "pt").count() == 5
    with pytest.raises(ValueError):
        readers.question_dim(spark, {"en": {"goal": ("ask", "if")}})


def test_dataset_packs_and_align(spark, tmp_path):
    frame = spark.createDataFrame
    sinks.write_dataset(frame([("a", "train", 1)], "wid string, split string, goal int"), frame([("m", "k")], "match string, kind string"), frame([("train", 1)], "split string, n int"), frame([("a", "t"), ("b", "u")], "wid string, text string"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/labels")).count() == 1 and spark.read.json(str(tmp_path / "d/cases")).count() == 2
    sinks.write_packs(frame([("m", "B0001", 0, 3.0, " one two"), ("m", "B0001", 1, 65.0, " three"), ("m", "B0002", 0, 70.0, " four")], "match string, block string, line int, line_start double, text string"), str(tmp_path / "p"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "p/match=m")).collect()] == ["## B0001", "[00:03] one two", "[01:05] three", "## B0002", "[01:10] four"]
    got = sinks.align_json(frame([("m", 2, 5.0), ("m", 1, 3.0)], "match string, period int, offset double")).first()["json"]
    assert json.loads(got) == {"1": {"offset": 3.0}, "2": {"offset": 5.0}}


def test_a_table_is_never_missing_while_it_is_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "idx int, v string, ts int")
    with pytest.raises(FileNotFoundError):
        sinks.read_upsert(spark, path)
    sinks.save_upsert(spark, rows((1, "a", 0)), path, ["idx"])
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append([tuple(r) for r in sinks.read_upsert(spark, path).collect()])

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 6):
        sinks.save_upsert(spark, rows((1, f"v{k}", k)), path, ["idx"])
    stop.set()
    reader.join()
    assert seen and all(len(x) == 1 for x in seen) and [x[0][2] for x in seen] == sorted(x[0][2] for x in seen)
    assert [tuple(r) for r in sinks.read_upsert(spark, path).collect()] == [(1, "v5", 5)]
    assert len([n for n in os.listdir(path) if n.startswith("version")]) == sinks.KEPT_VERSIONS


def test_a_writer_that_dies_and_two_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "idx int, v string, ts int")
    sinks.save_upsert(spark, rows((1, "a", 1)), path, ["idx"])

    def dies(old):
        old.write.parquet(f"{path}/version-0000000002-half")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.save_version(spark, path, dies)
    first = []

    def overtaken(old):
        if not first:
            first.append(sinks.save_upsert(spark, rows((2, "b", 1)), path, ["idx"]))
        return sinks.upsert_latest(old, rows((3, "c", 1)), ["idx"])

    assert sinks.save_version(spark, path, overtaken)
    assert sorted(tuple(r) for r in sinks.read_upsert(spark, path).collect()) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]


def test_batches_that_come_again(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "idx int, v string, ts int")
    assert [sinks.save_upsert(spark, rows((1, f"v{b}", n)), path, ["idx"], batch=b) for n, b in enumerate((0, 0, 1, 0, 1))] == [True, False, True, False, False]
    assert [r["v"] for r in sinks.read_upsert(spark, path).collect()] == ["v1"]


def test_raw_events_of_many_matches(spark, tmp_path):
    one = [{"id": "a", "type": {"name": "Shot"}, "period": 1, "timestamp": "00:00:05.000", "shot": {"statsbomb_xg": 0.4, "outcome": {"name": "Goal"}}}, {"id": "b", "type": {"name": "Offside"}, "period": 1, "timestamp": "00:00:01.000"}]
    (tmp_path / "x-1.json").write_text(json.dumps(one))
    (tmp_path / "y é.json").write_text(json.dumps(one[1:], indent=1))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "bad.json").write_text("[{")
    got = [(r["match"], r["index"], r["id"], r["type"]["name"]) for r in readers.raw_events_of(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("x-1", 0, "a", "Shot"), ("x-1", 1, "b", "Offside"), ("y é", 0, "b", "Offside")]
    sinks.land_raw_events(readers.raw_events_of(spark, str(tmp_path)), str(tmp_path / "again"))
    assert sorted((r["match"], r["index"], r["id"]) for r in readers.raw_events_of(spark, str(tmp_path / "again")).collect()) == sorted(x[:3] for x in got)


def test_parameters_from_a_file(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("windows:\n  length_s: 30   # longer\nlabels:\n  goal_span: [-5, 10]\n  card_fallback_span: [1, 2]\nevents:\n  match_tolerance_s: 20\n  merge_gap_s: 15\n")
    got = readers.load_config(spark, str(tmp_path / "p.yaml"))
    assert (got.windows.length, got.windows.stride, got.labels.goal_span, got.labels.min_overlap, got.events.gap, got.events.max_len) == (30.0, 5.0, (-5.0, 10.0), 3.0, 15.0, 120.0)
    assert got.events.tolerance["goal"] == (-20.0, 20.0) and got.events.tolerance["card"] == (-10.0, 120.0)
    assert config.read_config("") == config.Config()
    for bad in ("windows: {lenght: 3}", "window: {}"):
        with pytest.raises(ValueError):
            config.read_config(bad)


def test_review_and_gold_join_by_idx(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idx int, wid string")
    labels = spark.createDataFrame([(1, ("yes", None)), (3, ("no", True)), (9, ("yes", False))], "idx int, labels struct<verdict:string,unsure:boolean>")
    assert sorted(tuple(r) for r in readers.review_rows(labels, items).select("idx", "wid", "verdict", "unsure").collect()) == [(1, "a", "yes", False), (3, "c", "no", True)]


def test_predictions_of_runs_stay_apart(spark, tmp_path):
    path = str(tmp_path / "p")
    row = lambda n: spark.createDataFrame([("w", "goal", n, None), ("w", "intensity", None, 1.5)], "wid string, question string, noul double, score double")
    for tag, n in (("a", 0.1), ("b", 0.2), ("a", 0.3)):
        sinks.write_predictions(row(n), path, tag)
    assert [(r["answers"]["goal"]["noul"], r["answers"]["intensity"]["score"], r["tag"]) for t in "ab" for r in readers.predictions_of(spark, path, t).collect()] == [(0.3, 1.5, "a"), (0.2, 1.5, "b")]
    assert readers.predictions_of(spark, path, "c").collect() == []


def test_scores_must_cover_gold(spark):
    from tidemark.operators import evaluate

    gold = spark.createDataFrame([("w1", 1, "goal", 1, 1.0, False), ("w2", 2, "goal", 0, 1.0, False), ("w3", 3, "goal", 0, 1.0, True), ("w4", 4, "card", None, 1.0, False)], "wid string, seq int, question string, label int, weight double, unsure boolean")
    scores = lambda *wids: spark.createDataFrame([("m", w, "goal", 0.5, 1) for w in wids], "method string, wid string, question string, score double, pred int")
    assert evaluate.window_metrics(scores("w1", "w2", "w9"), gold).first()["n"] == 2
    with pytest.raises(KeyError):
        evaluate.window_metrics(scores("w1", "w9"), gold)


def test_many_matches_land_in_few_files(spark, tmp_path):
    from pathlib import Path

    from tidemark.plans import streams

    raw = streams.raw_events(spark, "/root/testdata/sf0.001")
    n = raw.select("match").distinct().count()
    sinks.land_raw_lines(raw, str(tmp_path / "lines"))
    assert n > 8 and len(list(Path(tmp_path / "lines").rglob("part-*"))) <= 4
    got = readers.raw_event_lines(spark, str(tmp_path / "lines"))
    assert got.count() == raw.count() and got.select("match").distinct().count() == n
    assert sorted(r["id"] for r in got.select("id").collect()) == sorted(r["id"] for r in raw.select("id").collect())
