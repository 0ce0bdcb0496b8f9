"""The engine's relations over the driver's tables: streams, events, words, windows and spans to run its operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import seconds

#: Rules that occur in the tables' texts, in place of the narration vocabulary.
RULES = {"goal": r"\bthe\b", "big_chance": r"\bof\b", "controversy": r"\bder\b|\bdie\b", "card": r"\bla\b"}
CUES = (("the_call", "goal", r"the\b", 2.0, 30.0, 5.0), ("of_call", "goal", r"of (a|the)\b", 20.0, 30.0, 5.0), ("and_call", "corner", r"and\b", -12.0, 40.0, 1.0), ("in_call", "shot", r"in\b", 1.0, 12.0, 1.0))
KIND = {"purchase": "goal", "click": "shot", "error": "card", "signup": "corner", "view": "substitution"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match (user), event_id, t, type, value, xg."""
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(v) for kv in KIND.items() for v in kv])
    return e.select(F.col("user_id").alias("match"), "event_id", seconds(F.col("ts")).alias("t"), "event_type", kinds[F.col("event_type")].alias("type"), "value", F.least(F.col("value") / 500, F.lit(1.0)).alias("xg"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match (conversation), pos, start, end, word: tokens 0.4 s apart, a minute a turn; word keeps its leading blank."""
    c = table(spark, sf_dir, "conversations")
    each = c.select(F.col("conv_id").alias("match"), "turn", F.posexplode(F.split("text", r"\s+")).alias("at", "w")).where(F.col("w") != "")
    start = F.col("turn") * 60 + F.col("at") * 0.4
    pos = F.col("turn") * 100000 + F.col("at")
    return each.select("match", pos.alias("pos"), start.alias("start"), (start + 0.4).alias("end"), F.concat(F.lit(" "), "w").alias("word"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One period a conversation: its turns, from the first one's minute to a minute after the last one's."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy(F.col("conv_id").alias("match")).agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    return turns.select("match", F.lit(1).alias("period"), (F.col("a") * 60.0).alias("offset"), (F.col("a") * 60.0).alias("audio_start"), (F.col("b") * 60.0 + 60).alias("audio_end"))


def day_windows(spark: SparkSession, sf_dir: str, length: float = 14400.0, stride: float = 7200.0) -> DataFrame:
    """match (user), wid, start, end: windows of four hours, every two, over the 30 days of each user."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("match")).distinct()
    n = int((30 * 86400 - length) // stride)
    each = users.select("match", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    return each.select("match", F.concat_ws(":", F.col("match").cast("string"), F.col("k").cast("string")).alias("wid"), (F.col("k") * stride).cast("double").alias("start"), (F.col("k") * stride + length).cast("double").alias("end"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match, id, question, start, end, uncertain: an hour from each purchase (goal), click worth 50 or more (big_chance) and error
    (controversy)."""
    e = events(spark, sf_dir)
    q = F.when(F.col("event_type") == "purchase", "goal").when((F.col("event_type") == "click") & (F.col("value") >= 50), "big_chance").when(F.col("event_type") == "error", "controversy")
    return e.select("match", F.col("event_id").alias("id"), q.alias("question"), F.col("t").alias("start"), (F.col("t") + 3600).alias("end"), (F.col("event_id") % 5 == 0).alias("uncertain")).where("question is not null")


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match (source), seq (doc_id), start, end, text, and labels of documents: windows of 20 s, 5 s apart in a source's order."""
    d = table(spark, sf_dir, "documents")
    # ids alone are numbered, by bucket; a source's buckets begin where the counts of those before them end
    ids = d.select("doc_id", F.coalesce("source", F.lit("")).alias("_s"), F.floor(F.col("doc_id") / 4096).alias("_b"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = ids.groupBy("_s", "_b").agg(F.count("*").alias("_n")).select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = ids.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("doc_id")) - 1).join(first, ["_s", "_b"])
    k = (F.col("_first") + F.col("_r")).alias("_k")
    met = d.join(numbered.select("doc_id", k).join(table(spark, sf_dir, "labels"), "doc_id", "left"), "doc_id")
    return met.select(F.col("source").alias("match"), "doc_id", (F.col("_k") * 5.0).alias("start"), (F.col("_k") * 5.0 + 20).alias("end"), "text", "quality", "toxic", "lang")


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question (vector's label modulo 4), seq, score and label: a component of a vector as score, squeezed into [0, 1] with ties."""
    v = table(spark, sf_dir, "embeddings")
    raw = F.element_at("embedding", 1).cast("double")
    score = F.round(F.least(F.greatest(raw * 0.5 + 0.5, F.lit(0.0)), F.lit(1.0)), 2)
    y = (F.element_at("embedding", 2) + F.element_at("embedding", 1) > 0).cast("int")
    return v.select((F.col("label") % 4).cast("string").alias("question"), F.col("vec_id").alias("seq"), score.alias("score"), y.alias("label"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"), (F.col("vec_id") % 11 != 0).alias("sure"))
