"""Word streams and rules over texts: cleaning, hits, predictions, cues, packs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CUES, RULES, STOCK_PHRASES

UNICODE = "(?iuU)"


def hit_count(text: Column, pattern: str) -> Column:
    """Non-overlapping matches, whatever their case; null counts as an empty text."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNICODE + pattern), F.lit(0)))


def rule_hits(df: DataFrame, text: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """df with a count for each rule, and intensity: exclamation marks and hits of all rules. One pass does all rules."""
    found = df.select("*", *[hit_count(F.col(text), rx).cast("long").alias(q) for q, rx in rules.items()])
    marks = F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.replace(F.coalesce(text, F.lit("")), F.lit("!"), F.lit("")))
    return found.withColumn("intensity", marks + sum((F.col(q) for q in rules), F.lit(0)))


def rule_predict(hits: DataFrame, thresholds: dict[str, int], cuts: tuple[int, int]) -> DataFrame:
    """Adds <rule>_score in [0, 1], <rule>_pred, intensity_score (the count) and intensity_pred in 0, 1, 2."""
    out = hits
    for q, th in thresholds.items():
        out = out.withColumn(f"{q}_score", F.least(F.lit(1.0), F.col(q) / max(1, th))).withColumn(f"{q}_pred", (F.col(q) >= th).cast("int"))
    level = F.when(F.col("intensity") < cuts[0], 0).when(F.col("intensity") < cuts[1], 1).otherwise(2)
    return out.withColumn("intensity_score", F.col("intensity").cast("double")).withColumn("intensity_pred", level)


def not_stock(text: Column, pattern: str = STOCK_PHRASES) -> Column:
    return ~F.coalesce(text.rlike(UNICODE + pattern), F.lit(False))


def not_silent(no_speech: Column, logprob: Column) -> Column:
    """Missing figures count as 0, which keeps the segment."""
    return ~((F.coalesce(no_speech, F.lit(0.0)) > 0.8) & (F.coalesce(logprob, F.lit(0.0)) < -1.0))


def words_of_segments(segments: DataFrame) -> DataFrame:
    """(match, pos, start, end, word, p) of segments with words array<struct<start,end,word,p>>, without blank words, in order
    of start, then segment and place."""
    flat = segments.select("match", F.col("start").alias("_seg"), F.posexplode("words").alias("_at", "w")).where(F.trim("w.word") != "")
    order = Window.partitionBy("match").orderBy("w.start", "_seg", "_at")
    return flat.select("match", F.row_number().over(order).alias("pos"), "w.*")


def token_norm(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"(?U)[^\w]+", "")


MAX_REPEATS = 4


def _cut(words: list[str]) -> list[int]:
    """Places that survive: of an n-gram (n = 1 to 3) said more than MAX_REPEATS times in a row, later sayings go as they come.

    For each n a count is kept beside every survivor: how many words in a row, up to it, equal the word n places before. A text
    that ends with n * MAX_REPEATS such words ends with one n-gram said once more than it may be."""
    at: list[int] = []
    runs: list[tuple[int, ...]] = []
    for place, word in enumerate(words):
        here = tuple((runs[-1][n - 1] + 1) if len(at) >= n and words[at[-n]] == word else 0 for n in (1, 2, 3))
        at.append(place)
        runs.append(here)
        over = next((n for n in (1, 2, 3) if here[n - 1] >= n * MAX_REPEATS and any(words[k] for k in at[-n:])), 0)
        if over:
            del at[-over:], runs[-over:]
    return at


def cut_loops(words: DataFrame) -> DataFrame:
    """words (match, pos, word, ...) without runaway repetitions. A cut decides what later words are compared with, so the
    words of a match are folded in order, in one group each."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        return pdf.iloc[_cut([re.sub(r"[^\w]+", "", w.lower()) for w in pdf["word"]])]

    return words.groupBy("match").applyInPandas(fold, words.schema)


def text_between(words: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (match, id, start, end) with text: the words that start in [start, end), joined and trimmed."""
    mean = spans.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0.0
    cell = max(1e-3, 2 * mean)  # so a span is in one and a half cells on average, and a word meets the spans of its own
    cells = F.sequence(F.floor(F.col("start") / cell).cast("long"), F.floor(F.col("end") / cell).cast("long"))
    w = words.select("match", F.floor(F.col("start") / cell).cast("long").alias("_cell"), "pos", F.col("start").alias("_t"), "word")
    met = spans.where(F.col("end") >= F.col("start")).select("match", "id", "start", "end", F.explode(cells).alias("_cell")).join(w, ["match", "_cell"])
    said = met.where((F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("end"))).groupBy("match", "id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w"))
    out = spans.join(said, ["match", "id", "start", "end"], "left")
    joined = F.array_join(F.transform("_w", lambda x: x["word"]), "")
    return out.select(*spans.columns, F.trim(F.coalesce(joined, F.lit(""))).alias("text"))


def cue_hits(words: DataFrame, cues=CUES) -> DataFrame:
    """(match, cue, t): starts of words at which a cue's pattern matches the text of that and the next three words."""
    after = Window.partitionBy("match").orderBy("pos")
    tok = F.lower(F.trim("word"))
    ctx = F.concat_ws(" ", tok, *[F.lead(tok, k).over(after) for k in (1, 2, 3)])
    rows = words.select("match", "start", ctx.alias("ctx"))
    names = F.array_compact(F.array(*[F.when(F.col("ctx").rlike(f"^(?uU:{rx})"), F.lit(name)) for name, _, rx, *_ in cues]))
    return rows.select("match", F.explode(names).alias("cue"), F.col("start").alias("t"))


def pack_lines(words: DataFrame, blocks: DataFrame, line_s: float = 5.0, block_s: float = 20.0) -> DataFrame:
    """(match, block, line, line_start, text): the words of each block in lines; a line ends with the word that starts line_s
    or more after it began. Blocks are block_s long from their start, so each word finds its block by number."""
    origin = blocks.groupBy("match", "period").agg(F.min("start").alias("_o"), F.max("end").alias("_e"))
    w = words.join(origin, "match").where((F.col("start") >= F.col("_o")) & (F.col("start") < F.col("_e")))
    w = w.select("match", "period", F.floor((F.col("start") - F.col("_o")) / block_s).cast("long").alias("_k"), "pos", F.col("start").alias("t"), "word")
    grouped = w.groupBy("match", "period", "_k").agg(F.array_sort(F.collect_list(F.struct("t", "pos", "word"))).alias("ws"))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(x["t"].alias("s"), x["word"].alias("text"))
        last = F.element_at(acc["lines"], -1)
        grown = F.struct(last["s"].alias("s"), F.concat(last["text"], x["word"]).alias("text"))
        lines = F.when(acc["open"], F.concat(F.slice(acc["lines"], 1, F.size(acc["lines"]) - 1), F.array(grown))).otherwise(F.concat(acc["lines"], F.array(new)))
        begun = F.when(acc["open"], last["s"]).otherwise(x["t"])
        return F.struct(lines.alias("lines"), (x["t"] - begun < line_s).alias("open"))

    zero = F.struct(F.array().cast("array<struct<s:double,text:string>>").alias("lines"), F.lit(False).alias("open"))
    folded = grouped.select("match", "period", "_k", F.posexplode(F.aggregate("ws", zero, step)["lines"]).alias("line", "l"))
    numbered = blocks.join(origin, ["match", "period"]).select("match", "period", "block", F.round((F.col("start") - F.col("_o")) / block_s).cast("long").alias("_k"))
    return folded.join(numbered, ["match", "period", "_k"]).select("match", "block", "line", F.col("l.s").alias("line_start"), F.col("l.text").alias("text"))
