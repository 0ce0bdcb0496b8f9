"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting (Lou, Caruana and others, 2012 and 2013): the features take turns, and each adds a shallow tree on its own bins to
a lookup table; then the pairs of features with the largest gain do the same on a grid of coarser bins. A text's score is the sum
of what its bins hold, through the logistic function; batches of texts are scored by adding table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, bounded_batches, load, run_hashes, slices
from tidemark.llm.langid import held_out

#: The bound of the labelled rows that the model is fitted on.
MAX_ROWS = 20_000
#: Bins of a feature, alone and in a pair; rounds of boosting, over features and over pairs; pairs; leaves of a feature's tree.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES = 64, 16, 150, 60, 6, 3
RATE, RIDGE, LEAST_WEIGHT = 0.1, 1.0, 3.0
#: From this score on a text is predicted to be of quality 1.
THRESHOLD = 0.3

FEATURES = ("words", "word_bytes", "longest", "upper", "symbols", "digits", "stops", "shouts", "other_punctuation", "beyond_ascii", "sentence_ends", "repeats", "distinct", "lines", "repeated_lines")
_BLANK = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
_CLASSES = {
    "upper": [b for b in range(128) if chr(b).isupper()],
    "symbols": list(b"#*$%&|<>"),
    "digits": list(b"0123456789"),
    "stops": list(b".,;:"),
    "shouts": list(b"!?"),
    "other_punctuation": list(b"\"'()-/=@[\\]^_`{}~+"),
    "beyond_ascii": list(range(128, 256)),
}


def _distinct(of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n texts."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(of[new], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """FEATURES of whole texts, a row each. Shares are of bytes, words or lines; null and empty texts have 0 of everything."""
    data, bounds = as_bytes(texts)
    n, size = len(texts), np.maximum(np.diff(bounds), 1)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True

    def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (edge[:-1] | ~before))
        return starts, np.flatnonzero(inside & (edge[1:] | ~after)) + 1, np.searchsorted(bounds, starts, side="right") - 1

    starts, ends, of = runs(~_BLANK[data])
    hashes, lengths = run_hashes(data, starts, ends), ends - starts
    words = np.bincount(of, minlength=n)
    some = np.maximum(words, 1)
    out = {"words": np.log1p(words), "word_bytes": np.bincount(of, lengths, n) / some, "longest": np.zeros(n)}
    np.maximum.at(out["longest"], of, lengths)
    out["longest"] = np.log1p(out["longest"])
    for name, of_class in _CLASSES.items():
        at = np.flatnonzero(np.isin(np.arange(256), of_class)[data])
        out[name] = np.diff(np.searchsorted(at, bounds)) / size
    out["sentence_ends"] = np.bincount(of, np.isin(data[ends - 1], list(b".?!")), n) / some
    same = np.zeros(len(of))
    same[1:] = (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])
    out["repeats"] = np.bincount(of, same, n) / some
    out["distinct"] = _distinct(of, hashes, n) / some
    starts, ends, of = runs(data != ord("\n"))
    lines = np.bincount(of, minlength=n)
    out["lines"] = lines / some
    out["repeated_lines"] = 1 - _distinct(of, run_hashes(data, starts, ends), n) / np.maximum(lines, 1)
    out["repeated_lines"][lines == 0] = 0
    return np.stack([out[f] for f in FEATURES], axis=1)


@dataclass
class Additive:
    """Tables by bin: of each feature with its cuts, and of pairs (i, j) with the cuts of both."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Values that part the sample into bins of about equal size."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a run of bins, and the first bin after it; no gain if none leaves LEAST_WEIGHT on both sides."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gains = np.where((left_h >= LEAST_WEIGHT) & (all_h - left_h >= LEAST_WEIGHT), _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h), 0.0)
    at = int(np.argmax(gains)) if len(gains) else 0
    return (float(gains[at]), at + 1) if len(gains) and gains[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The values by bin of a tree grown best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda x: x[0])
        gain, at, a, b = best
        if not gain:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one side of a grid once and the other once in each half."""
    best, values = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            halves = [(a[:at].sum(0), b[:at].sum(0)), (a[at:].sum(0), b[at:].sum(0))]
            if min(y.sum() for _, y in halves) < LEAST_WEIGHT:
                continue
            gain = sum(_gain(x.sum(), y.sum()) + _best_cut(x, y)[0] for x, y in halves) - _gain(a.sum(), b.sum())
            if gain > best + 1e-9:
                best = gain
                found = np.concatenate([np.tile(_tree(x, y, 2), (n, 1)) for (x, y), n in zip(halves, (at, len(a) - at), strict=True)])
                values = found.T if turned else found
    return best, values


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """The model of labels y (0 or 1) by columns of x. Without rows it scores 0.5, with labels of one kind near that kind."""
    model = Additive()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    model.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(y):
        return model
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for at, table in zip(bins, model.tables, strict=True):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _tree(np.bincount(at, y - p, len(table)), np.bincount(at, p * (1 - p), len(table)), LEAVES)
            table += step
            margin += step[at]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    p = 1 / (1 + np.exp(-margin))

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        width = len(coarse[j]) + 1
        return np.bincount(bins[i] * width + bins[j], values, (len(coarse[i]) + 1) * width).reshape(-1, width)

    gains = sorted(((_grid_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), key=lambda g: (-g[0], g[1:]))
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, _, _, table in model.pairs:
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _grid_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            table += step
            margin += step[bins[i], bins[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", max_rows: int = MAX_ROWS) -> Additive:
    """The model of label (0 or 1) by the texts of the documents with its doc_id.

    At most max_rows labelled rows are taken, those whose hashed doc_id is least; more than that, no row leaves its task but as
    FEATURES. Null ids and labels are left out; labels and documents that repeat an id are all taken, up to max_rows pairs.
    """
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").alias("_d"), F.col(label).cast("double").alias("_y")).orderBy(F.xxhash64("_d"), "_d", "_y").limit(max_rows)
    rows = docs.select(F.col("doc_id").alias("_d"), F.col(text).alias("_x")).join(F.broadcast(drawn), "_d").select("_d", "_y", "_x")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(list(features(batch.column(2))), pa.list_(pa.float64()))], ["d", "y", "x"])

    bounded_batches(docs.sparkSession)
    found = rows.mapInArrow(measured, "d long, y double, x array<double>").orderBy(F.xxhash64("d"), "d", "y", "x").limit(max_rows).collect()
    return boost(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in found]))


def score(df: DataFrame, model: Additive, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1, higher: label 1 likelier) and predicted (1 from threshold on), replacing columns of these names. Every row
    gets them, null and empty texts too; equal texts get equal scores."""
    known = df.sparkSession.sparkContext.broadcast(model)  # some thousands of numbers

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [known.value.score(features(part.column(0))) for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], 0)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    out = df.select(*kept, scored(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels that aren't held out."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
