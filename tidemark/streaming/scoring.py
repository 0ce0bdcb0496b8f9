"""Scorers: what turns windows into scores, batch by batch, in a stream or not.

A scorer is a class whose instances are made in the workers, once a task, and called with a frame of (wid, text) to give a frame
of one column a question, a row for each, between 0 and 1. Anything else (a served model, say) fits by the same contract.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text import rule_hits


class KeywordScorer:
    """Rule hits over a threshold of each rule."""

    def __init__(self, rules: dict[str, str], thresholds: dict[str, int]):
        self.rules = {q: re.compile(rx, re.IGNORECASE) for q, rx in rules.items()}
        self.thresholds = thresholds

    def __call__(self, windows: pd.DataFrame) -> pd.DataFrame:
        count = lambda rx: windows["text"].fillna("").map(lambda t: sum(1 for _ in rx.finditer(t)))
        return pd.DataFrame({q: (count(rx) / max(1, self.thresholds[q])).clip(upper=1.0) for q, rx in self.rules.items()})


def score(windows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], questions: list[str]) -> DataFrame:
    """windows (wid, text, ...) with a double column for each question and latency_ms: how long its batch took to score, by
    window. Columns of these names are replaced; a null text is scored as the scorer likes."""
    kept = [c for c in windows.columns if c not in (*questions, "latency_ms")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*kept).schema.fields], *[f"`{q}` double" for q in questions], "latency_ms double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for batch in batches:
            if len(batch):
                began = time.perf_counter()
                got = scorer(batch[["wid", "text"]])
                took = (time.perf_counter() - began) * 1000 / len(batch)
                yield batch.assign(**{q: got[q].to_numpy(dtype=float) for q in questions}, latency_ms=took)

    return windows.select(*kept).mapInPandas(run, schema)


def keyword_scores(windows: DataFrame, rules: dict[str, str], thresholds: dict[str, int]) -> DataFrame:
    """What score() gives with a KeywordScorer, by built-in functions and without a latency."""
    hits = rule_hits(windows, rules=rules)
    return hits.select(*windows.columns, *[F.least(F.lit(1.0), F.col(q) / max(1, thresholds[q])).alias(q) for q in rules])


def saved_scores(windows: DataFrame, predictions: DataFrame, questions: list[str]) -> DataFrame:
    """windows, a stream or not, with the saved scores of their wid (predictions: wid and a column a question); a window without one
    has null scores, which are never positive. Predictions are a static side: a stream joins each batch to them."""
    kept = [c for c in windows.columns if c not in questions]
    return windows.select(*kept).join(predictions.select("wid", *[F.col(q).cast("double").alias(q) for q in questions]), "wid", "left").select(*kept, *questions)
