"""Readers: declared schemas, bad lines kept apart, missing inputs as empty frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import LEVELS, QUESTIONS, Config, read_config
from tidemark.operators.events import RAW

SEGMENT = "match string, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, temperature double, words array<struct<start:double,end:double,word:string,p:double>>"
EVENT = "match string, type string, period int, t double, minute int, second int, team string, player string, sb_id string, xg double, outcome string, shot_type string, shootout boolean, card string, via string"
WINDOW = "wid string, match string, split string, period int, start double, end double, t_start double, text string, n_words long"
PREDICTION = "wid string, answers map<string,struct<noul:double,score:double,probabilities:map<string,double>>>"
LABEL = "wid string, match string, split string, period int, start double, end double, labels struct<goal:int,big_chance:int,controversy:int,card:int,intensity:int>"
REGISTRY = "id string, split string, kickoff_utc string, competition string, youtube string, source string, kind string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False, bad: bool = False) -> DataFrame:
    """Rows of JSON lines. Blank lines are skipped; with bad, lines that don't parse have their text in _corrupt_record, and
    without it they are dropped. With missing_ok, a path without files is an empty frame."""
    full = schema + ", _corrupt_record string"
    if missing_ok and not exists(spark, path):
        rows = spark.createDataFrame([], full)
    else:
        # read as text first: a line that is all blanks isn't a record
        lines = spark.read.text(path).where(F.trim("value") != "")
        rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows if bad else rows.where("_corrupt_record is null").drop("_corrupt_record")


def raw_events(spark: SparkSession, path: str, match: str) -> DataFrame:
    """A landed JSON array of raw events."""
    schema = RAW.replace("match string, ", "", 1)
    return spark.read.schema(schema).json(path, multiLine=True).select(F.lit(match).alias("match"), "*")


def raw_events_of(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events of all matches landed in a folder, in one scan: a JSON array a match, in `<match>.json` or in files of a folder
    `match=<match>`. index is the place in the array; a file that isn't JSON gives no rows."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")).alias("_f"))
    of = F.coalesce(*[F.when(F.regexp_extract("_f", rx, 1) != "", F.url_decode(F.regexp_extract("_f", rx, 1))) for rx in (r"/match=([^/]+)/[^/]*$", r"/([^/]+)\.json[^/]*$")])
    element = RAW.replace("match string, index int, ", "", 1)
    each = files.select(of.alias("match"), F.posexplode(F.from_json("value", f"array<struct<{_as_struct(element)}>>")).alias("index", "e"))
    return each.where("match is not null and e is not null").select("match", "index", "e.*")


def raw_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """As raw_events_of, of the lines that sinks.land_raw_lines wrote; a line that isn't JSON gives no rows."""
    element = RAW.replace("match string, index int, ", "", 1)
    lines = spark.read.text(path).select(F.from_json("value", f"struct<match:string,events:array<struct<{_as_struct(element)}>>>").alias("r"))
    each = lines.select(F.col("r.match").alias("match"), F.posexplode("r.events").alias("index", "e"))
    return each.where("match is not null and e is not null").select("match", "index", "e.*")


def _as_struct(ddl: str) -> str:
    """Top-level columns of a schema as fields of a struct."""
    return ",".join(":".join(column.split(" ", 1)) for column in ddl.split(", "))


def registry(spark: SparkSession, rows: list[dict], spares: list[dict] = (), include_spares: bool = False, split: str | None = None) -> DataFrame:
    """Matches of a parsed registry; spares have the split `spare`."""
    names = [c.split()[0] for c in REGISTRY.split(", ")]
    told = list(rows) + ([r | {"split": "spare"} for r in spares] if include_spares else [])
    out = spark.createDataFrame([tuple(r.get(n) for n in names) for r in told], REGISTRY)
    return out.where(F.col("split") == split) if split else out


def load_registry(spark: SparkSession, path: str, **options) -> DataFrame:
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    found = yaml.safe_load(text)
    return registry(spark, found["matches"], found.get("spares", []), **options)


def load_config(spark: SparkSession, path: str) -> Config:
    """Parameters of a YAML file wherever Spark can read it."""
    return read_config("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def get_match(matches: DataFrame, id_: str) -> dict:
    found = matches.where(F.col("id") == id_).limit(1).collect()
    if not found:
        raise KeyError(id_)
    return found[0].asDict()


def teacher_lines(lines: DataFrame) -> DataFrame:
    """lines (match, line, value) with kind_of: span, intensity, or what is wrong with it, and the parsed fields. Blank lines
    are left out."""
    kinds = "kind string, q string, start string, end string, block string, level string, uncertain boolean, note string, _bad string"
    parsed = lines.where(F.trim("value") != "").select("match", "line", "value", F.from_json("value", kinds, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("match", "line", "value", "r.*")
    num = lambda c: F.when(F.get_json_object("value", f"$.{c}").rlike(r"^-?[0-9.]+([eE][-+]?\d+)?$") & F.col("value").rlike(rf'"{c}"\s*:\s*-?[0-9]'), F.expr(f"try_cast({c} as double)"))
    s, e = num("start"), num("end")
    ok_span = F.coalesce(F.col("q").isin(*QUESTIONS) & (e >= s), F.lit(False))
    told = (
        F.when(F.col("_bad").isNotNull(), "not JSON")
        .when(F.col("kind") == "span", F.when(ok_span, "span").otherwise("bad span"))
        .when(F.col("kind") == "intensity", F.when(F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "intensity").otherwise("bad intensity"))
        .otherwise("unknown kind")
    )
    return parsed.select("match", "line", told.alias("kind_of"), F.col("q").alias("question"), s.alias("start"), e.alias("end"), "block", "level", F.coalesce("uncertain", F.lit(False)).alias("uncertain"), F.coalesce("note", F.lit("")).alias("note"))


def level_number(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in LEVELS]), level).cast("int") - 1


def teacher(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, levels, problems) of teacher_lines; of a block's levels, the last line counts."""
    spans = parsed.where("kind_of = 'span'").select("match", "question", "start", "end", "uncertain", "note")
    levels = parsed.where("kind_of = 'intensity'").groupBy("match", "block").agg(F.max_by(F.struct("level", "uncertain"), "line").alias("b"))
    problems = parsed.where("kind_of not in ('span', 'intensity')").select("match", F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("kind_of")).alias("detail"))
    return spans, levels.select("match", "block", level_number(F.col("b.level")).alias("level"), "b.uncertain"), problems


def captions(events: DataFrame) -> DataFrame:
    """(match, seq, start, end) of landed captions (match, events array<struct<tStartMs,dDurationMs,segs>>) that have any text."""
    each = events.select("match", F.posexplode("events").alias("seq", "e"))
    said = F.exists(F.coalesce("e.segs", F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(F.trim(s["utf8"]) != "", F.lit(False)))
    start = F.col("e.tStartMs") / 1000
    return each.where(said).select("match", "seq", start.alias("start"), (start + F.coalesce(F.col("e.dDurationMs"), F.lit(0)) / 1000).alias("end"))


def speech_window(hints: DataFrame, events: DataFrame) -> DataFrame:
    """(match, from_s, to_s) of hints (match, hint, duration): the part of a stream worth transcribing, from 25 minutes before
    kickoff to 155 after it, 40 more with extra time and 15 with a shootout, within the stream; all of it (to_s null) without
    a hint or without events."""
    seen = events.groupBy("match").agg(F.bool_or(F.col("period") == 3).alias("extra"), F.bool_or(F.col("period") == 5).alias("shootout"))
    met = hints.join(seen, "match", "left")
    known = F.col("hint").isNotNull() & F.col("extra").isNotNull()
    minutes = 155 + F.when(F.col("extra"), 40).otherwise(0) + F.when(F.col("shootout"), 15).otherwise(0)
    to = F.least(F.col("hint") + minutes * 60, F.coalesce("duration", F.lit(1e9)))
    return met.select("match", F.when(known, F.greatest(F.lit(0.0), F.col("hint") - 1500.0)).otherwise(0.0).alias("from_s"), F.when(known, to).alias("to_s"))


BLOCK = "match string, block string, period int, start double, end double, clock string"
REVIEW = "idx int, labels struct<verdict:string,unsure:boolean>, ts double"
GOLD = "idx int, wid string, labels map<string,int>, ts double"


def parts(spark: SparkSession, path: str, column: str, values: list[str], schema: str) -> DataFrame:
    """JSON lines of some folders `column=value`; those that aren't there have no rows, and no other is listed or read."""
    out = None
    for v in values:
        part = jsonl(spark, f"{path}/{column}={v}", schema, missing_ok=True).withColumn(column, F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{schema}, {column} string")


def labels_of(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """(wid, match, split, question, label) of label files by split (a folder `split=<name>` each), nulls too."""
    rows = parts(spark, path, "split", splits, LABEL.replace("split string, ", ""))
    each = F.array(*[F.struct(F.lit(q).alias("question"), F.col("labels")[q].alias("label")) for q in (*QUESTIONS, "intensity")])
    return rows.select("wid", "match", "split", F.explode(each).alias("x")).select("wid", "match", "split", "x.*")


def predictions_of(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Saved predictions of one model run, from its folder `tag=<name>`."""
    return parts(spark, path, "tag", [tag], PREDICTION)


def windows_for(windows: DataFrame, matches: DataFrame, splits: list[str], match: str | None = None) -> DataFrame:
    """windows of the registry's matches of some splits, or of one match among them."""
    wanted = matches.where(F.col("split").isin(splits))
    wanted = wanted.where(F.col("id") == match) if match else wanted
    return windows.join(wanted.select(F.col("id").alias("match")), "match", "left_semi")


def gold_rows(labels: DataFrame, sample: DataFrame) -> DataFrame:
    """Gold labels (idx, labels, ...) with the sampled windows (idx, wid, start, stratum, weight, ...) they are of."""
    return labels.drop("wid").join(sample, "idx")


def review_rows(labels: DataFrame, items: DataFrame) -> DataFrame:
    """Items of a review (idx, ...) with the verdict that was saved for them (labels: REVIEW); an item without one isn't in the result."""
    return items.join(labels.select("idx", F.col("labels.verdict").alias("verdict"), F.coalesce("labels.unsure", F.lit(False)).alias("unsure")), "idx")


def block_ranges(spark: SparkSession, path: str) -> DataFrame:
    """BLOCK rows that sinks.write_blocks saved; no folder, no rows."""
    return jsonl(spark, path, BLOCK, missing_ok=True)


def question_dim(spark: SparkSession, texts: dict[str, dict[str, tuple[str, str]]], lang: str | None = None) -> DataFrame:
    """(question, kind, lang, instructions, criteria) of what a scorer is asked: texts by language and question. Every language must ask
    all questions and the level of intensity, and nothing else."""
    asked = {*QUESTIONS, "intensity"}
    for name, by in texts.items():
        if set(by) != asked:
            raise ValueError(f"{name} asks {sorted(set(by) ^ asked)} too much or too little")
        if not all(a.strip() and c.strip() for a, c in by.values()):
            raise ValueError(f"{name} has a question without a text")
    rows = [(q, "ordinal" if q == "intensity" else "binary", name, *by[q]) for name, by in texts.items() for q in sorted(by)]
    out = spark.createDataFrame(rows, "question string, kind string, lang string, instructions string, criteria string")
    return out.where(F.col("lang") == lang) if lang else out
