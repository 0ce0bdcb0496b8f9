"""Sinks: partitioned tables, JSON exports, keyed upserts, frozen outputs and the report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sampling import shuffled
from tidemark.sources.shared import content, file_system, names, publish


def write_table(df: DataFrame, path: str, by: list[str], frozen: bool = False) -> None:
    """Parquet partitioned by columns. A frozen table refuses to be written twice; others replace just the partitions of df."""
    writer = df.repartition(*by).write.partitionBy(*by)
    if frozen:
        writer.mode("errorifexists").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def land_raw_events(raw: DataFrame, path: str) -> None:
    """Raw events (match, index if there is one, and columns of events.RAW) as a JSON array a match, in folders `match=<match>`."""
    raw.groupBy("match").agg(F.to_json(_listed(raw)).alias("value")).write.mode("overwrite").partitionBy("match").text(path)


def land_raw_lines(raw: DataFrame, path: str) -> None:
    """As land_raw_events, but a line a match with its array, {"match": ..., "events": [...]}, in as many files as tasks: for so many matches
    that a folder each would be more than a store lists or renames in time."""
    each = raw.groupBy("match").agg(_listed(raw).alias("events"))
    each.select(F.to_json(F.struct(F.col("match").cast("string").alias("match"), "events")).alias("value")).write.mode("overwrite").text(path)


def _listed(raw: DataFrame) -> Column:
    """The events of a match as an array, by index if there is one."""
    rest = [c for c in raw.columns if c not in ("match", "index")]
    if "index" not in raw.columns:
        return F.collect_list(F.struct(*rest))
    return F.transform(F.array_sort(F.collect_list(F.struct("index", F.struct(*rest).alias("e")))), lambda x: x["e"])


def write_predictions(scores: DataFrame, path: str, tag: str) -> None:
    """Answers of one model run (wid, question, noul, score, probabilities if there are any) as JSON lines of readers.PREDICTION, in the
    run's folder `tag=<tag>`; other runs stay."""
    fields = [F.col(c) if c in scores.columns else F.lit(None).cast(t).alias(c) for c, t in (("noul", "double"), ("score", "double"), ("probabilities", "map<string,double>"))]
    answers = F.map_from_entries(F.collect_list(F.struct("question", F.struct(*fields).alias("a")))).alias("answers")
    write_jsonl(scores.groupBy("wid").agg(answers), f"{path}/tag={tag}")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Block ranges as JSON lines of readers.BLOCK."""
    write_jsonl(blocks.select("match", "block", "period", "start", "end", "clock"), path)


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], at: str = "ts") -> DataFrame:
    """One row for each key: the latest by `at`, of equals the new one. Rows of a key are reduced before they are shuffled."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_new")]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), "_new")).alias("_r"))
    return best.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


#: Versions that a table keeps, so that readers of an older one may finish.
KEPT_VERSIONS = 3


def _current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number of a table's newest version (0: none) and what its pointer says. A pointer is put in place by one rename and never
    changed, so there is always one to read."""
    found = [n for n in names(spark, f"{path}/_current") if n.isdigit()]
    return (int(found[-1]), json.loads(content(spark, f"{path}/_current/{found[-1]}"))) if found else (0, {})


def read_upsert(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that save_upsert writes."""
    number, pointer = _current(spark, path)
    if not number:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(f"{path}/{pointer['folder']}")


def save_version(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame], batch: int | None = None) -> bool:
    """A new version of a table, made of the old one (None: there is none) and written beside it; then a pointer to it. Readers see either,
    whole, at any time, and a writer that dies leaves the old one. Of two writers at once the later one makes it again. A batch number
    that isn't above the last one changes nothing and gives False, so that a batch may come twice."""
    while True:
        number, pointer = _current(spark, path)
        last = pointer.get("batch")
        if batch is not None and last is not None and batch <= last:
            return False
        folder = f"version-{number + 1:010d}-{uuid.uuid4().hex[:12]}"
        make(spark.read.parquet(f"{path}/{pointer['folder']}") if number else None).write.parquet(f"{path}/{folder}")
        if publish(spark, f"{path}/_current/{number + 1:010d}", json.dumps({"folder": folder, "batch": last if batch is None else batch})):
            break
        _delete(spark, f"{path}/{folder}")
    for name in names(spark, path):
        if name.startswith("version-") and int(name.split("-")[1]) <= number + 1 - KEPT_VERSIONS:
            _delete(spark, f"{path}/{name}")
    for name in names(spark, f"{path}/_current"):
        if name.isdigit() and int(name) <= number + 1 - KEPT_VERSIONS:
            _delete(spark, f"{path}/_current/{name}")
    return True


def _delete(spark: SparkSession, path: str) -> None:
    store, at = file_system(spark, path)
    store.delete(at, True)


def save_upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str], at: str = "ts", batch: int | None = None) -> bool:
    """upsert_latest into a table, as a new version of it (see save_version)."""
    return save_version(spark, path, lambda old: upsert_latest(new.limit(0) if old is None else old, new, key, at), batch)


_TIMELINE = "match string, highlights array<struct<start:double,end:double,question:string,peak_prob:double,peak_wid:string,first_latency_ms:double>>, trace array<struct<t:double,score:double,ms:double>>"


class TimelineSink:
    """For foreachBatch: what a player of a stream needs, a row a match that grows with every batch of rows as streaming.highlights
    gives them. A batch that comes twice, or late after a restart, changes nothing."""

    def __init__(self, path: str, thresholds: dict[str, float]):
        self.path, self.thresholds = path, thresholds

    def take(self, rows: DataFrame, batch: int) -> None:
        highlight = F.when(F.col("kind") == "highlight", F.struct("start", "end", "question", "peak_prob", "peak_wid", "first_latency_ms"))
        trace = F.when(F.col("kind") == "trace", F.struct(F.col("end").alias("t"), F.col("peak_prob").alias("score"), F.col("first_latency_ms").alias("ms")))
        new = rows.groupBy("match").agg(F.collect_list(highlight).alias("highlights"), F.collect_list(trace).alias("trace"))

        def grown(old: DataFrame | None) -> DataFrame:
            both = new if old is None else old.unionByName(new)
            return both.groupBy("match").agg(*[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("highlights", "trace")])

        save_version(rows.sparkSession, self.path, grown, batch)

    def read(self, spark: SparkSession) -> DataFrame:
        """(match, json) so far: highlights by start, the traced scores by time, thresholds, and n, median and 90th percentile (the value
        at place int(0.9 n)) of the windows' latencies; no latency_ms without one."""
        table = read_upsert(spark, self.path) if _current(spark, self.path)[0] else spark.createDataFrame([], _TIMELINE)
        ms = F.sort_array(F.filter(F.transform("trace", lambda x: x["ms"]), lambda x: x.isNotNull()))
        n = F.size("_ms")
        median = (F.get("_ms", F.floor((n - 1) / 2).cast("int")) + F.get("_ms", F.floor(n / 2).cast("int"))) / 2
        timed = F.when(n > 0, F.struct(n.alias("n"), median.alias("p50"), F.get("_ms", F.floor(n * 0.9).cast("int") - 1).alias("p90")))
        told = F.create_map(*[F.lit(v) for q, t in self.thresholds.items() for v in (q, float(t))])
        trace = F.transform("trace", lambda x: F.struct(x["t"].alias("t"), x["score"].alias("score")))
        return table.withColumn("_ms", ms).select("match", F.to_json(F.struct("highlights", trace.alias("trace"), timed.alias("latency_ms"), told.alias("thresholds"))).alias("json"))


def blind(items: DataFrame, allowed=("idx", "wid", "question", "clock", "prev_text", "text", "start", "end", "t")) -> DataFrame:
    """What a labeller may see: the listed columns alone, so neither stratum, source nor score."""
    return items.select(*[c for c in items.columns if c in allowed])


def review_items(candidates: DataFrame, periods: DataFrame, words: DataFrame) -> DataFrame:
    """(match, question, t, wid, sources, clock, prev_text, text) of pooled candidates, with the words around each moment."""
    from tidemark.functions.scalar import clock
    from tidemark.operators.intervals import asof_period
    from tidemark.operators.text import text_between

    items = candidates.select("match", "question", F.round("t", 1).alias("t"), "sources", F.concat(F.lit("review:"), "question", F.lit(":"), F.round("t", 1).cast("string")).alias("wid"))
    points = items.select("match", F.col("wid").alias("id"), "t")
    per = asof_period(points, periods).join(periods.select("match", "period", "offset"), ["match", "period"])
    named = per.select("match", F.col("id").alias("wid"), F.concat(F.lit("P"), F.col("period").cast("string"), F.lit(" "), clock(F.col("t") - F.col("offset"))).alias("clock"))
    around = lambda a, b, name: text_between(words, points.select("match", "id", (F.col("t") + a).alias("start"), (F.col("t") + b).alias("end"))).select("match", F.col("id").alias("wid"), F.col("text").alias(name))
    return items.join(named, ["match", "wid"]).join(around(-40, -20, "prev_text"), ["match", "wid"]).join(around(-20, 25, "text"), ["match", "wid"])


def results_json(window: DataFrame, event: DataFrame) -> DataFrame:
    """(method, json): the figures of each method by question, nested. window: method, question and metrics; event: likewise."""
    nest = lambda df, name: df.groupBy("method").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", F.struct(*[c for c in df.columns if c not in ("method", "question")]).alias("m"))))).alias(name))
    return nest(window, "window").join(nest(event, "event"), "method", "full").select("method", F.to_json(F.struct("window", "event")).alias("json"))


def write_dataset(labels: DataFrame, disagreements: DataFrame, balance: DataFrame, cases: DataFrame, path: str) -> None:
    """The four outputs of a label build under one folder: labels by split, disagreements, balance, and training cases in the order of a
    hash. Labels are written first and the rest may be made from what is read back."""
    write_table(labels, f"{path}/labels", ["split"])
    write_jsonl(disagreements, f"{path}/disagreements")
    write_jsonl(balance.coalesce(1), f"{path}/balance")  # a few rows
    write_jsonl(shuffled(cases, "wid"), f"{path}/cases")


def write_packs(lines: DataFrame, path: str) -> None:
    """A folder of text for each match: its blocks in order, a head line each, and the lines of narration with their clock."""
    from tidemark.functions.scalar import clock

    told = F.concat(F.lit("["), clock(F.col("line_start")), F.lit("] "), F.trim("text"))
    heads = lines.groupBy("match", "block").agg(F.min("line_start").alias("line_start")).select("match", "block", F.lit(-1).alias("line"), F.concat(F.lit("## "), "block").alias("value"))
    rows = heads.unionByName(lines.select("match", "block", "line", told.alias("value")))
    rows.repartition("match").sortWithinPartitions("match", "block", "line").select("match", "value").write.mode("overwrite").partitionBy("match").text(path)


def align_json(periods: DataFrame) -> DataFrame:
    """(match, json) of fitted periods: an object keyed by period."""
    cols = [c for c in periods.columns if c not in ("match", "period")]
    entries = F.array_sort(F.collect_list(F.struct(F.col("period").cast("string").alias("k"), F.struct(*cols).alias("v"))))
    return periods.groupBy("match").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def fmt(value, places: int = 2) -> str:
    return "–" if value is None else f"{value:.{places}f}"


def report(window: list, event: list, questions: list[str], levels: list = (), calibration: list = (), latency: list = ()) -> str:
    """Markdown tables from collected rows, a row a method (so a few dozen at most): windows with gold positives, events, and where rows
    are given the levels of intensity (method, n, accuracy, mae), calibration (method, question, ece) and latency (name, n, p50, p90)."""
    methods = list(dict.fromkeys(r["method"] for r in window))
    w = {(r["method"], r["question"]): r for r in window}
    e = {(r["method"], r["question"]): r for r in event}
    golds = {r["question"]: r["positives"] for r in window if "positives" in (r.asDict() if hasattr(r, "asDict") else r)}
    out = ["Gold positives: " + ", ".join(f"{q.replace('_', ' ')} {golds[q]}" for q in questions if q in golds), ""] if golds else []
    out += ["| method | " + " | ".join(q.replace("_", " ") for q in questions) + " |", "|---" * (len(questions) + 1) + "|"]
    for m in methods:
        out.append(f"| {m} | " + " | ".join(f"{fmt(w[m, q]['f1'])} ({fmt(w[m, q]['ap'])})" if (m, q) in w else "–" for q in questions) + " |")
    out += ["", "| method | " + " | ".join(f"{q.replace('_', ' ')}: caught / events · true / triggers · minutes" for q in questions) + " |", "|---" * (len(questions) + 1) + "|"]
    for m in methods:
        cell = lambda r: f"{r['caught']}/{r['events']} · {r['true_triggers']}/{r['triggers']} · {r['minutes']:.0f}"
        out.append(f"| {m} | " + " | ".join(cell(e[m, q]) if (m, q) in e else "–" for q in questions) + " |")
    if levels:
        out += ["", "| method | windows | intensity accuracy | mean error |", "|---|---|---|---|", *[f"| {r['method']} | {r['n']} | {fmt(r['accuracy'])} | {fmt(r['mae'])} |" for r in levels]]
    if calibration:
        ece = {(r["method"], r["question"]): r["ece"] for r in calibration}
        asked = [*questions, "pooled"]
        out += ["", "| method, ECE | " + " | ".join(q.replace("_", " ") for q in asked) + " |", "|---" * (len(asked) + 1) + "|"]
        out += [f"| {m} | " + " | ".join(fmt(ece.get((m, q)), 3) for q in asked) + " |" for m in dict.fromkeys(r["method"] for r in calibration)]
    if latency:
        out += ["", "| latency, ms | n | p50 | p90 |", "|---|---|---|---|", *[f"| {r['name']} | {r['n']} | {fmt(r['p50'], 1)} | {fmt(r['p90'], 1)} |" for r in latency]]
    return "\n".join(out) + "\n"


