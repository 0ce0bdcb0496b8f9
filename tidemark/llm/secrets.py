"""Secret scans: three fixed patterns, and a linear-chain conditional random field that tags tokens as B, I or O.

The field sees each token's shape, those of its neighbours (three before, one after) and what the whole file looks like.
It is trained here, by likelihood, on a bounded sample of rows that the patterns label; Viterbi decodes whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes, bounded_batches, discard, held_model, load, slices, written

#: The bound of the training sample: distinct texts with a pattern, as many without, and characters of one text.
SAMPLE_TEXTS, SAMPLE_TEXT_CHARS = 200, 4_000
#: Windows drawn around each secret of the sample. Few texts hold one, and with one window each the field learned to tag nothing.
HIT_WINDOWS = 8

# The patterns and least lengths that define the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private")

_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
OFFSETS = (-3, -2, -1, 0, 1)
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches long enough, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of hex digits matches as a whole, so a run of 24 or more is a match that is long enough
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


# --- tokens and features --------------------------------------------------------------------------------------------

# classes of bytes: 0 blank, 1 of a word, 2 punctuation, 3 beyond ASCII
_CLASS = np.full(256, 3, np.uint8)
_CLASS[:128] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_DIGIT, _UPPER, _SMALL, _SIGN = _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("+/_-")
_NOT_HEX, _CODE, _LINE = 1 - _table("0123456789abcdefABCDEF"), _table("{}()[]=;"), _table("\n")
_KIND = np.full(256, 7, np.int64)
_KIND[[ord(c) for c in "=:\"'.,"]] = np.arange(1, 7)
_KIND[_CLASS == 1] = 0
_KIND[_CLASS == 3] = 8
#: Values of each feature: kind of character, length, digits, capitals, small letters, switches, hex, keyword, signs.
SIZES = (9, 7, 4, 3, 3, 3, 2, 2, 2)
N_SETS = int(np.prod(SIZES)) + 1  # 0: beyond the ends of the text
N_FILE = 4


class Tokens:
    """The tokens of texts that lie one after another in data: runs of word bytes, runs beyond ASCII, and single other signs;
    and of each its feature set, a number below N_SETS."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        kind = _CLASS[data]
        edge = np.ones(n, bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge[bounds[:-1][bounds[:-1] < n]] = True
        places = np.flatnonzero(edge)
        begins = kind[places] != 0
        self.start, self.end = places[begins], np.append(places[1:], n)[begins]
        self.first = np.searchsorted(self.start, bounds)  # of each text, its first token
        self.bounds = bounds

        def count(table: np.ndarray) -> np.ndarray:
            sums = np.zeros(n + 1, np.int32)
            np.cumsum(table[data], out=sums[1:])
            return sums

        digit, upper, code = count(_DIGIT), count(_UPPER), count(_CODE)
        of = lambda sums: (sums[self.end] - sums[self.start]).astype(np.int64)
        size = self.end - self.start
        part = lambda k: (k > 0).astype(np.int64) + ((k > 0) & (k == size))
        digits = of(digit)
        turn = np.zeros(n + 1, np.int32)
        d, u = _DIGIT[data], _UPPER[data]
        np.cumsum((d[1:] != d[:-1]) | (u[1:] != u[:-1]), out=turn[2:])
        turns = np.where(size > 1, turn[self.end] - turn[np.minimum(self.start + 1, self.end)], 0)
        lead = _KIND[data[self.start]] if n else np.zeros(0, np.int64)
        values = (
            lead, np.searchsorted([2, 4, 8, 16, 32, 64], size, "right"), np.where(digits == 0, 0, np.where(digits * 4 < size, 1, np.where(digits < size, 2, 3))), part(of(upper)), part(of(count(_SMALL))),
            np.searchsorted([3, 6], turns, "right"), ((size >= 8) & (of(count(_NOT_HEX)) == 0)).astype(np.int64), self._keyword(data, lead, size), (of(count(_SIGN)) > 0).astype(np.int64),
        )
        self.sets = np.ravel_multi_index(values, SIZES) + 1 if len(size) else np.zeros(0, np.int64)
        # of the whole text: always on; many signs of code; long lines only; digits in number
        length = np.maximum(1, np.diff(bounds))
        per = lambda sums: np.diff(sums[bounds])
        self.files = np.stack([np.ones(len(length)), per(code) > 0.01 * length, per(count(_LINE)) < length / 400, per(digit) > 0.03 * length], 1).astype(np.float32)

    def _keyword(self, data: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a token ends with a keyword and a sign of assignment or a quote follows."""
        out = np.zeros(len(size), np.int64)
        after = np.append(lead[1:], 0)
        at = np.flatnonzero((lead == 0) & (size >= 3) & (after >= 1) & (after <= 4))
        for i in at:
            word = _LOWER[data[self.start[i] : self.end[i]]].tobytes().decode().replace("-", "_")
            out[i] = word.endswith(KEYWORDS)
        return out

    def near(self) -> np.ndarray:
        """len(OFFSETS) rows: the feature set at each offset from each token of the same text."""
        texts = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))
        at = np.arange(len(self.sets)) + 3 * (texts + 1)
        padded = np.zeros(len(self.sets) + 3 * len(self.bounds) + 3, np.int64)
        padded[at] = self.sets
        return np.stack([padded[at + o] for o in OFFSETS])


def tokens_of(texts: list[str]) -> Tokens:
    return Tokens(*as_bytes(pa.array(texts, pa.string())))


def scores(weights: list[np.ndarray]) -> np.ndarray:
    """Scores of all feature sets, from the weights of each feature's values (values x 3)."""
    grid = np.zeros((*SIZES, 3), np.float32)
    for k, w in enumerate(weights):
        grid += w.reshape([len(w) if i == k else 1 for i in range(len(SIZES))] + [3])
    return np.concatenate([np.zeros((1, 3), np.float32), grid.reshape(-1, 3)])


# --- training -------------------------------------------------------------------------------------------------------


def _tags(text: str, tokens: Tokens) -> np.ndarray:
    """B, I, O of the tokens of one text, from the base matches (of an assignment, its value)."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    spans += [(s, e) for s, k, e in base_spans(text) if k]
    out = np.zeros(len(tokens.start), np.int64)
    for s, e in spans:
        a, b = len(text[:s].encode()), len(text[:e].encode())
        inside = np.flatnonzero((tokens.start < b) & (tokens.end > a))
        out[inside] = I
        out[inside[:1]] = B
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _long_enough(texts: list[str], window: int) -> Iterator[str]:
    short, n = [], 0
    for text in texts:
        size = len(tokens_of([text]).sets)
        if size >= window:
            yield text
        elif size:
            short.append(text)
            n += size
            if n >= window:
                yield "\n".join(short)
                short, n = [], 0
    if n:
        yield "\n".join(short * (window // n + 1))


def train(texts: list[str], steps: int = 120, window: int = 24, seed: int = 7) -> dict | None:
    """Weights by gradient ascent on the conditional likelihood of windows of tokens; None if no text has a secret. Texts of less than
    a window are lines of one text, until it has a window."""
    rng = np.random.default_rng(seed)
    near, tags, files = [], [], []
    for text in _long_enough(texts, window):
        tokens = tokens_of([text])
        n = len(tokens.sets)
        y, around = _tags(text, tokens), tokens.near()
        hits = np.flatnonzero(y == B)
        starts = {max(0, min(n - window, int(h) - int(rng.integers(4, window - 4)))) for h in hits for _ in range(HIT_WINDOWS)}
        starts |= {int(s) for s in rng.integers(0, n - window + 1, 6)}
        for s in sorted(starts):
            near.append(around[:, s : s + window])
            tags.append(y[s : s + window])
            files.append(tokens.files[0])
    if not near or not any(t.any() for t in tags):
        return None
    x, y, z = np.stack(near, 1), np.stack(tags), np.stack(files).astype(np.float64)  # offsets x windows x tokens
    seen, x = np.unique(x, return_inverse=True)
    x = x.reshape(len(OFFSETS), *y.shape)
    # the features of each set seen, as ones in a row; the set beyond the ends has none
    firsts = np.cumsum((0, *SIZES))
    on = np.zeros((len(seen), sum(SIZES)))
    for k, v in enumerate(np.unravel_index(np.maximum(seen - 1, 0), SIZES)):
        on[np.arange(len(seen)), firsts[k] + v] = 1
    on[seen == 0] = 0
    n, length = y.shape
    w = {"shape": np.zeros((len(OFFSETS), sum(SIZES), 3)), "file": np.zeros((N_FILE, 3)), "move": np.zeros((3, 3))}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    gold = np.eye(3)[y]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        emit = sum((on @ w["shape"][o])[x[o]] for o in range(len(OFFSETS))) + (z @ w["file"])[:, None, :]
        fore, back = np.empty_like(emit), np.zeros_like(emit)
        fore[:, 0] = emit[:, 0]
        for t in range(1, length):
            fore[:, t] = emit[:, t] + _logsum(fore[:, t - 1][:, :, None] + w["move"], 1)
        for t in range(length - 2, -1, -1):
            back[:, t] = _logsum(w["move"] + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = _logsum(fore[:, -1], 1)
        own = np.exp(fore + back - total[:, None, None])
        pairs = np.exp(fore[:, :-1, :, None] + w["move"] + (emit + back)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
        off = gold - own
        slope = {"move": gold_moves - pairs, "file": z.T @ off.sum(1), "shape": np.zeros_like(w["shape"])}
        for o in range(len(OFFSETS)):
            by_set = np.zeros((len(on), 3))
            np.add.at(by_set, x[o].ravel(), off.reshape(-1, 3))
            slope["shape"][o] = on.T @ by_set
        for k in w:
            g = slope[k] / n - 1e-4 * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            w[k] = w[k] + 0.15 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.round(6) for k, v in w.items()}


# --- decoding -------------------------------------------------------------------------------------------------------


def viterbi(emit: np.ndarray, move: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
    """The best tags; before and after are the fixed tags next to the stretch, if there are any."""
    best = emit[0] + (move[before] if before is not None else 0)
    came = []
    for e in emit[1:]:
        all_ = best[:, None] + move
        came.append(all_.argmax(0))
        best = all_.max(0) + e
    if after is not None:
        best = best + move[:, after]
    tag = int(best.argmax())
    out = [tag]
    for row in reversed(came):
        tag = int(row[tag])
        out.append(tag)
    return out[::-1]


def decode(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Viterbi over all tokens. Where O leads by more than two moves can ever make up for, every best path has O; such
    tokens are fixed first and only the stretches between them are searched, which gives the same tags."""
    sure = emit[:, O] - emit[:, 1:].max(1) > 2 * (move.max() - move.min())
    tags = np.zeros(len(emit), np.int64)
    open_ = np.flatnonzero(~sure)
    if len(open_):
        cuts = np.flatnonzero(np.diff(open_) > 1) + 1
        for run in np.split(open_, cuts):
            a, b = run[0], run[-1] + 1
            tags[a:b] = viterbi(emit[a:b], move, O if a else None, O if b < len(emit) else None)
    return tags


class Tagger:
    """The field, ready to tag: the score of every feature set at every offset is a row of a table."""

    def __init__(self, weights: dict):
        self.w = weights
        cuts = np.cumsum(SIZES)[:-1]
        self.tables = [scores([p.astype(np.float32) for p in np.split(w, cuts)]) for w in weights["shape"]]

    def tag(self, tokens: Tokens) -> dict[int, list[tuple[int, int]]]:
        """{text: byte spans within it} of the texts with a secret."""
        if not len(tokens.sets):
            return {}
        whole = (tokens.files @ self.w["file"].astype(np.float32)).astype(np.float32)
        emit = np.repeat(whole, np.diff(tokens.first), axis=0)
        for table, at in zip(self.tables, tokens.near(), strict=True):
            emit += table[at]
        move = self.w["move"]
        open_ = np.flatnonzero(emit[:, O] - np.maximum(emit[:, B], emit[:, I]) <= 2 * (move.max() - move.min()))
        out = {}
        for i in np.unique(np.searchsorted(tokens.first, open_, "right") - 1):
            a, b = tokens.first[i], tokens.first[i + 1]
            tags = decode(emit[a:b].astype(np.float64), move)
            spans: list[tuple[int, int]] = []
            for k in np.flatnonzero(tags):
                s, e = (int(v[a + k] - tokens.bounds[i]) for v in (tokens.start, tokens.end))
                if tags[k] == I and spans and k and tags[k - 1]:
                    spans[-1] = (spans[-1][0], e)
                else:
                    spans.append((s, e))
            if spans:
                out[int(i)] = spans
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of one text, in code points."""
        raw = text.encode()
        return [(len(raw[:s].decode()), len(raw[:e].decode())) for s, e in self.tag(tokens_of([text])).get(0, [])]


def find_all(column: pa.Array, tagger: Tagger | None) -> dict[int, tuple[list, list]]:
    """{row: (base spans, all spans)} of the rows of a text column that have any; spans as (start, kind, end). All spans are the
    base ones and those of the field that touch none of them."""
    data, bounds = as_bytes(column)
    if not len(data):
        return {}
    tokens = Tokens(data, bounds)
    field = tagger.tag(tokens) if tagger else {}
    # a base match has an = or a :, or lies in a word token of at least 20 bytes
    marked = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data == 61) | (data == 58), out=marked[1:])
    hopeful = np.diff(marked[bounds]) > 0
    hopeful[np.searchsorted(tokens.first, np.flatnonzero(tokens.end - tokens.start >= LEAST["access"]), "right") - 1] = True
    out = {}
    for i in sorted({*np.flatnonzero(hopeful).tolist(), *field}):
        text = column[i].as_py()
        base = base_spans(text)
        raw = text.encode() if i in field else b""
        more = [(len(raw[:s].decode()), 3, len(raw[:e].decode())) for s, e in field.get(i, [])]
        more = [(s, k, e) for s, k, e in more if not any(a < e and s < b for a, _, b in base)]
        if base or more:
            out[i] = (base, sorted(base + more))
    return out


def find(text: str | None, tagger: Tagger | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    return find_all(pa.array([text], pa.string()), tagger).get(0, ([], []))


# --- Spark ----------------------------------------------------------------------------------------------------------


_HEX_RUN = r"(?<![0-9a-f])[0-9a-f]{24}"
_VALUE = r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6})"


def fit(docs: DataFrame, text: str = "text", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_TEXT_CHARS) -> dict | None:
    """Weights learned from a bounded sample: `texts` distinct texts that hold a base pattern and as many that don't, by hash of
    the text, `chars` characters of each, around the pattern if there is one. None if nothing holds a pattern.

    One pass marks texts, as hashes; a second fetches the few that are drawn."""
    x = F.col(text)
    signs = x.contains("=") | x.contains(":")
    hit = F.when(signs, x.rlike(_VALUE)).otherwise(False) | F.when(x.contains("AKIA"), x.rlike("AKIA[A-Z0-9]{16}")).otherwise(False) | x.rlike(_HEX_RUN)
    marked = written(docs.where(x.isNotNull()).select(F.xxhash64(x).alias("h"), hit.alias("hit")), "secret-marks")
    counts = {r["hit"]: r["n"] for r in marked.groupBy("hit").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts.get(True):
        return None
    limit = F.when(F.col("hit"), F.lit(min(1.0, 2 * texts / counts[True]))).otherwise(F.lit(min(1.0, 2 * texts / max(1, counts.get(False, 0)))))
    drawn = marked.where(F.pmod("h", F.lit(1_000_000)) < limit * 1_000_000).distinct()
    # by hash, `texts` of each kind at most
    picked = {k: [r["h"] for r in drawn.where(F.col("hit") == k).orderBy("h").limit(texts).collect()] for k in (True, False)}
    wanted = picked[True] + picked[False]
    at = F.greatest(F.lit(1), F.greatest(F.regexp_instr(x, F.lit(_VALUE)), F.regexp_instr(x, F.lit("AKIA[A-Z0-9]{16}")), F.regexp_instr(x, F.lit(_HEX_RUN))) - chars // 2)
    found = docs.where(F.xxhash64(x).isin(wanted)).groupBy(F.xxhash64(x).alias("h")).agg(F.first(F.substr(x, at, F.lit(chars))).alias("x"))
    by = {r["h"]: r["x"] for r in found.collect()}
    discard(marked)
    return train([by[h] for h in wanted if h in by])


def _tagger(weights: dict | None) -> Tagger | None:
    if weights is None:
        return None
    key = hashlib.sha256(b"".join(weights[k].tobytes() for k in sorted(weights))).hexdigest()
    return held_model(("secrets", key), lambda: Tagger(weights))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, weights: dict | None, text: str = "text", redact: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with base and spans, arrays of (kind, start, end) in code points; with redact, also redacted:
    the text with each span replaced. A null or empty text has no spans (redacted keeps it as it is). Whole texts are
    scanned; columns of these names are replaced; repeated rows get the same answer each. weights None leaves only the
    base spans.
    """
    new = ["base", "spans"] + ["redacted"] * (redact is not None)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    bounded_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(weights)  # a few kilobytes
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("base", _SPANS), T.StructField("spans", _SPANS), *[T.StructField("redacted", T.StringType())] * (redact is not None)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(model.value)
        told = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in slices(batches, n, 2 << 20):
            column = batch.column(n)
            found = find_all(column, tagger)
            none = ([], [])
            cols = [pa.array([told(found.get(i, none)[j]) for i in range(batch.num_rows)], arrow) for j in (0, 1)]
            if redact is not None:
                texts = column.to_pylist() if found else None
                cols.append(pa.array([_cut(t, found[i][1], redact) if i in found else t for i, t in enumerate(texts)], pa.string()) if found else column)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], names=[*kept, *new])

    return df.select(*kept, F.col(text).alias("_text_")).mapInArrow(run, schema)


def _cut(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for s, _, e in spans:
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join([*out, text[done:]])


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs), keep=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
