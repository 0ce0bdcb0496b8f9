"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text. A text is parsed against it greedily into the longest phrases that
occur there (Ziv and Merhav, 1993); the number of phrases times the log of the automaton's text length estimates the
cross-entropy, and the language with the smallest estimate wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, held_model, load

#: The bound of the sample that the automata are fitted on: characters for each language, and characters of one text.
SAMPLE_CHARS, SAMPLE_TEXT_CHARS = 32_768, 2_048
_BUCKETS = 1_000_000
#: Entries of a table with every state and character (4 bytes each). Beyond it the moves there are, at most three a sample character
#: (12 bytes each), are searched instead, so memory grows with the samples and not with the alphabet.
MAX_TABLE = 1 << 24
#: Characters parsed at once, and the number of texts below which each goes on alone.
SIDE_BY_SIDE_CHARS, ALONE = 3 << 20, 12


def letters(text: Column) -> Column:
    """Lower-case letters and marks, everything else as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", chars: int = SAMPLE_CHARS, text_chars: int = SAMPLE_TEXT_CHARS) -> dict[str, str]:
    """{language: sample of its text}, from rows with a language and a letter.

    The sample is bounded: `chars` characters a language, `text_chars` of one text. Texts are drawn by their hash, each
    distinct text once, so copies neither crowd the sample nor reach the driver. The draw is the same on every run.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("x"))
    stats = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("texts"), F.avg(F.least(F.char_length("x"), F.lit(text_chars))).alias("mean")).collect()
    if not stats:
        return {}
    share = {s["l"]: min(1.0, (4 * chars / max(s["mean"], 1.0) + 20) / max(s["texts"], 1)) for s in stats}
    limits = F.create_map(*[F.lit(v) for l, p in share.items() for v in (l, math.ceil(p * _BUCKETS))])
    drawn = rows.where(F.pmod("h", F.lit(_BUCKETS)) < limits[F.col("l")])
    # letters() of a slice twice as long leaves enough letters, and keeps what moves small
    drawn = drawn.groupBy("l", "h").agg(F.first(F.substring(letters(F.substring("x", 1, 2 * text_chars)), 1, text_chars)).alias("x"))
    out: dict[str, str] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["l"], r["h"])):
        if len(out.get(r["l"], "")) < chars:
            out[r["l"]] = (out.get(r["l"], "") + " " + r["x"])[:chars]
    return {k: v for k, v in sorted(out.items()) if v.strip()}


def _moves(text: str) -> list[dict[str, int]]:
    """The automaton that accepts the substrings of text: of each state, the state that a character leads to; 0 is the root."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for ch in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in moves[p]:
            moves[p][ch] = new
            p = link[p]
        if p >= 0:
            q = moves[p][ch]
            if length[q] != length[p] + 1:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(ch) == q:
                    moves[p][ch] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
    return moves


def suffix_automaton(text: str) -> dict:
    """The root of the automaton that accepts the substrings of text; a state is a dict from a character to a state."""
    moves = _moves(text)
    states: list[dict] = [{} for _ in moves]
    for state, to in zip(states, moves, strict=True):
        for ch, t in to.items():
            state[ch] = states[t]
    return states[0]


def phrases(text: str, root: dict, state: dict | None = None) -> int:
    """Phrases of the greedy parse, from a state if given; a character that the automaton lacks is a phrase of its own. Parser counts
    the same for many texts and languages at once."""
    n, state = 0, root if state is None else state
    for ch in text:
        if ch in state:
            state = state[ch]
        else:
            n += state is not root
            if ch in root:
                state = root[ch]
            else:
                n += 1
                state = root
    return n + (state is not root)


class Parser:
    """The automata of all languages, as arrays. Many texts are parsed side by side, a character of each at a time. A row is a state's
    number times the width of the alphabet; row and character lead to the next row and the number of phrases that end."""

    def __init__(self, samples: dict[str, str]):
        self.langs, self.logs = list(samples), [math.log2(len(s) + 1) for s in samples.values()]
        alphabet = sorted({ch for s in samples.values() for ch in s})
        self.width = len(alphabet) + 1  # 0: a character that no sample has
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(ch) for ch in alphabet]] = np.arange(1, self.width)
        place = {ch: i + 1 for i, ch in enumerate(alphabet)}
        keys, rows, base, self.row = [], [], 0, np.zeros(len(samples), np.int64)
        self.begin = np.zeros((len(samples), self.width), np.int64)  # where each language's root leads; 0: nowhere
        for j, sample in enumerate(samples.values()):
            moves = _moves(sample)
            state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            ch = np.fromiter((place[c] for m in moves for c in m), np.int64, len(state))
            to = (np.fromiter((t for m in moves for t in m.values()), np.int64, len(state)) + base) * self.width
            self.row[j] = base * self.width
            self.begin[j, ch[state == 0]] = to[state == 0]
            keys.append((state + base) * self.width + ch)
            rows.append(to)
            base += len(moves)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.to = key[order], np.concatenate(rows)[order] if rows else key
        self.table = self._whole(base) if 0 < base * self.width <= MAX_TABLE else None

    def _whole(self, states: int) -> np.ndarray:
        """Of every row and character, the next row times four plus the phrases that end."""
        out = np.empty((states, self.width), np.int32)
        ends = [*(self.row[1:] // self.width).tolist(), states]
        for j, (a, b) in enumerate(zip((self.row // self.width).tolist(), ends, strict=True)):
            lacks = self.begin[j] == 0
            out[a:b] = np.where(lacks, self.row[j], self.begin[j]) * 4 + 1 + lacks
            out[a] -= lacks  # a root has no phrase to end
        flat = out.ravel()
        flat[self.key] = self.to * 4
        return flat

    def _next(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows (texts x languages) and a character of each text: the next rows, and the phrases that end."""
        if self.table is not None:
            found = self.table.take(row + code[:, None])
            return found >> 2, found & 3
        want = row + code[:, None]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit, begin = self.key[at] == want, self.begin[:, code].T
        ends = 1 + ((begin == 0) & (row != self.row))
        return np.where(hit, self.to[at], np.where(begin == 0, self.row, begin)), np.where(hit, 0, ends)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) by the automaton of each language (columns)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        at = 0
        while at < len(texts) and self.langs:
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SIDE_BY_SIDE_CHARS):
                size += len(texts[to])
                to += 1
            out[at:to] = self._side_by_side(texts[at:to])
            at = to
        return out

    def _side_by_side(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        order = np.argsort(-lengths, kind="stable")
        start, left = (np.cumsum(lengths) - lengths)[order], lengths[order]
        row, n = np.tile(self.row if self.table is None else self.row.astype(np.int32), (len(texts), 1)), np.zeros((len(texts), len(self.langs)), np.int64)
        done, live = 0, int((left > 0).sum())
        while live >= (ALONE if self.table is not None else 1):
            until = int(left[live - 1])
            begin, m = start[:live], n[:live]
            for k in range(done, until):
                row[:live], ends = self._next(row[:live], codes.take(begin + k))
                m += ends
            done, live = until, int((left > until).sum())
        if live:
            table = memoryview(self.table)
            for i in range(live):
                rest = codes[start[i] + done : start[i] + left[i]].tolist()
                for j in range(len(self.langs)):
                    r, total = int(row[i, j]), 0
                    for c in rest:
                        found = table[r + c]
                        total += found & 3
                        r = found >> 2
                    row[i, j] = r
                    n[i, j] += total
        out = np.empty_like(n)
        out[order] = n + (row != self.row)
        return out


def _parser(samples: dict[str, str]) -> Parser:
    """Built once in each Python worker."""
    return held_model(("langid", *samples.items()), lambda: Parser(samples))


def identify(df: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1), replacing columns of these names.

    lang_pred is `und` if the text is null or empty, has no letter, or nothing was learned; the score is 0 then. Else the
    score is the runner-up's share of the two best estimates (0.5: a tie, which the first name wins), or 1 with one
    language. Whole texts are parsed; repeated rows get the same answer each.
    """
    bounded_batches(df.sparkSession)
    # the samples are bounded by SAMPLE_CHARS a language
    model = df.sparkSession.sparkContext.broadcast(samples)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = _parser(model.value)
        for texts in batches:
            some = [t or "" for t in texts]
            ranked = np.argsort(estimates := parser.counts(some) * np.array(parser.logs), axis=1, kind="stable")
            langs, scores = [], []
            for t, order, e in zip(some, ranked, estimates, strict=True):
                if not t or not parser.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                langs.append(parser.langs[order[0]])
                scores.append(float(e[order[1]] / (e[order[0]] + e[order[1]])) if len(order) > 1 else 1.0)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    known = F.when(F.col(text).rlike(r"\p{L}"), letters(F.col(text)))
    out = df.select(*kept, predicted(known).alias("_p"))
    return out.select(*kept, "_p.lang_pred", "_p.score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out of learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled documents that aren't held out."""
    docs = load(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    samples = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), samples).select("doc_id", "held_out", "lang_pred", "score")
