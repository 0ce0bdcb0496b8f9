"""Suffix-array dedup: bytes in any string of WIDTH bytes that starts at two places or more.

All suffixes are far larger than the text, so the array is sparse. Of the SEED-byte strings in a window of WIDTH bytes, the
one with the least fingerprint is the window's anchor (the first, among equals). Equal windows have equal anchors at equal
offsets, so windows need comparing only where their anchors are equal. A run is a stretch of windows with one anchor; it
carries WIDTH - 1 bytes more than it has windows.

1. Runs of all texts. Those that a text says twice are repeated for certain, so they leave as spans and one run; periodic text
   is a handful of rows, however long. Anchors that occur once are dropped: their windows are unique.
2. Runs of one content (same anchor, same hash of the bytes) are counted; a content that occurs twice is repeated as a whole.
3. One copy of each content fetches its bytes, and the suffixes at its anchor are range-partitioned by their leading bytes,
   with splitters that Spark samples. Within a range, the windows of all contents with one anchor are sorted on their bytes by a
   multikey sort, eight bytes a key, which leaves out what stands alone, and neighbours are compared. No anchor is in two
   ranges, so no range need look across its boundaries.
4. An anchor with more contents than MOST_CONTENTS is not left to one range: its windows go out as 128-bit fingerprints that
   are counted before and after a shuffle, so that no task has all of a frequent passage. STEP windows go as one row, by the offset of
   the anchor in them: where another content has all their bytes, all are repeated; where none has the bytes that all of them share, none
   is. Only blocks between the two, one of each content, go out window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Rolling, as_bytes, discard, load, row_keys, slices, written

WIDTH, SEED = 200, 32
#: Contents that share an anchor and are sorted in one range, at most (about 300 bytes each).
MOST_CONTENTS = 500
#: Windows of a frequent anchor that are counted as one block first.
STEP = 16
#: Windows of a text that are looked at together, so that memory doesn't grow with its length.
BLOCK = 4 << 20
_LOW = 24  # bits of a place within a block


def window_anchors(data: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, Rolling]:
    """For each window of data, where its anchor starts."""
    roll = Rolling(data)
    n = len(data) - width + 1
    span = width - seed + 1
    marks = (roll.every(seed) >> U64(_LOW) << U64(_LOW)) | np.arange(len(data) - seed + 1, dtype=U64)
    # least of each `span` neighbours: suffix minima of one block of `span` and prefix minima of the next
    pad = -len(marks) % span
    grid = np.concatenate([marks, np.full(pad, ~U64(0), U64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    return (least & U64((1 << _LOW) - 1)).astype(np.int64), roll


def runs_of(data: np.ndarray, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Runs of one text: start, windows, anchor's offset, fingerprint of the anchor, hash of the run's bytes, and k: how often the text
    has that content (2 stands for more), with one run for all of them. Where it is 2, spans with k = 0 cover all of them
    (start, and bytes in place of windows)."""
    out = []
    for at in range(0, max(0, len(data) - width + 1), BLOCK):
        part = data[at : at + BLOCK + width - 1]
        anchors, roll = window_anchors(part, width, seed)
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        n = np.diff(np.append(first, len(anchors)))
        place = anchors[first]
        raw = memoryview(np.ascontiguousarray(part))
        hashed = np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(first.tolist(), (first + n + width - 1).tolist(), strict=True)], U64)
        out.append((first + at, n, place - first, roll.of(place, place + seed), hashed))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    start, n, off, a, c = (np.concatenate(x) for x in zip(*out, strict=True))
    _, one, which, times = np.unique(c, return_index=True, return_inverse=True, return_counts=True)
    if len(one) == len(c):
        return start, n, off, a, c, np.ones(len(c), np.int64)
    again = times[which] > 1
    s, e = start[again], (start + n)[again] + width - 1  # runs come in order, so their ends do
    new = np.concatenate([[True], s[1:] > e[:-1]])
    s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
    none = np.zeros(len(s), U64)
    cols = zip((start, n, off, a, c, np.minimum(times, 2)[which]), (s, e - s, np.zeros(len(s), np.int64), none, none, np.zeros(len(s), np.int64)), strict=True)
    return tuple(np.concatenate([x[one], y]) for x, y in cols)


RUNS = "_d bigint, _t bigint, start int, n int, off int, a bigint, c bigint, k int"


def _runs(docs: DataFrame, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            data, bounds = as_bytes(batch.column(2))
            d, t = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            got = [runs_of(data[bounds[i] : bounds[i + 1]], width, seed) for i in range(batch.num_rows)]
            rows = np.repeat(np.arange(batch.num_rows), [len(g[0]) for g in got])
            start, n, off, a, c, k = (np.concatenate(x) for x in zip(*got, strict=True))
            cols = [d[rows], t[rows], *(x.astype(np.int32) for x in (start, n, off)), *(x.astype(U64).view(np.int64) for x in (a, c)), k.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["_d", "_t", "start", "n", "off", "a", "c", "k"])

    return docs.select("_d", "_t", "_x").mapInArrow(run, RUNS)


def sort_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int, seed: int) -> np.ndarray:
    """For each window, whether another one of its group has the same bytes: a multikey sort, eight bytes a key from the first on, that
    leaves out, key by key, what stands alone; what is left at the end are equal neighbours."""
    live, block = np.arange(len(starts)), group
    for at in [*range(0, width - 8, 8), width - 8]:
        if not len(live):
            break
        value = data[starts[live][:, None] + np.arange(at, at + 8)].view(">u8").ravel()
        order = np.lexsort((value, block))
        live, block, value = live[order], block[order], value[order]
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (value[1:] != value[:-1])])
        block = np.cumsum(new)
        held = np.bincount(block)[block] > 1
        live, block = live[held], block[held]
    out = np.zeros(len(starts), bool)
    out[live] = True
    return out


def _spans(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Covered bytes of a run, given which of its windows are repeated."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > width) + 1
    return [(int(x[0]), int(x[-1]) + width) for x in np.split(at, cut)]


FOUND = "a bigint, c bigint, spans array<struct<s:int,e:int>>"


def _compared(contents: DataFrame, width: int, seed: int) -> DataFrame:
    """Spans of contents (a, c, n, off, bytes), sorted by anchor in their partition; none for those without."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        a, c, n, x = (list(v) for v in zip(*rows, strict=True))
        data = np.frombuffer(b"".join(x), np.uint8)
        firsts = np.concatenate([[0], np.cumsum([len(v) for v in x])[:-1]])
        counts = np.array(n)
        ends = np.cumsum(counts)
        starts = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(firsts, counts)
        group = np.repeat(np.unique(np.array(a), return_inverse=True)[1], counts)
        flags = sort_windows(data, starts, group, width, seed)
        spans = [_spans(f, width) for f in np.split(flags, ends[:-1])]
        keep = [i for i, s in enumerate(spans) if s]
        told = [[{"s": s, "e": e} for s, e in spans[i]] for i in keep]
        return pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64()), pa.array(told, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["a", "c", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size > BLOCK and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush(rows)

    return contents.select("a", "c", "n", "bytes").mapInArrow(run, FOUND)


def _blocks(contents: DataFrame, width: int) -> DataFrame:
    """A row for each block of windows of each content: its first and last window's place in the run, a fingerprint of the bytes that all
    windows of such a block share, and two of all its bytes. Windows with equal bytes are in blocks with equal shared bytes."""
    step = min(STEP, width // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4, 1 << 18):
            data, bounds = as_bytes(batch.column(4))
            n, off = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            # the anchor is at off - r in window r; blocks part these offsets, from the last window's to the first's
            low, counts = (off - n + 1) // step, off // step - (off - n + 1) // step + 1
            rows = np.repeat(np.arange(batch.num_rows), counts)
            block = low[rows] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            lo, hi = np.maximum(0, off[rows] - block * step - step + 1), np.minimum(n[rows] - 1, off[rows] - block * step)
            base, roll = bounds[rows], Rolling(data)
            shared = base + off[rows] - block * step
            h = [roll.of(shared, shared - step + 1 + width), roll.of(base + lo, base + lo + width // 2), roll.of(base + lo + width // 2, base + hi + width)]
            cols = [*(batch.column(k).take(pa.array(rows)) for k in (0, 1)), *(pa.array(x.astype(np.int32)) for x in (lo, hi)), *(pa.array(x.view(np.int64)) for x in h)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "c", "lo", "hi", "h", "u1", "u2"])

    return contents.select("a", "c", "n", "off", "bytes").mapInArrow(run, "a bigint, c bigint, lo int, hi int, h bigint, u1 bigint, u2 bigint")


def _windows(blocks: DataFrame, width: int) -> DataFrame:
    """A row for each window of blocks (a, c, lo, hi, k, bytes of the content): its place in the run and two fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5, 1 << 18):
            data, bounds = as_bytes(batch.column(5))
            lo, hi = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            counts = hi - lo + 1
            rows = np.repeat(np.arange(batch.num_rows), counts)
            at = lo[rows] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts, roll = bounds[rows] + at, Rolling(data)
            h = [roll.of(starts, starts + width // 2), roll.of(starts + width // 2, starts + width)]
            cols = [*(batch.column(k).take(pa.array(rows)) for k in (0, 1, 4)), pa.array(at.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in h)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "c", "k", "r", "h1", "h2"])

    return blocks.select("a", "c", "lo", "hi", "k", "bytes").mapInArrow(run, "a bigint, c bigint, k bigint, r int, h1 bigint, h2 bigint")


def _counted(contents: DataFrame, width: int) -> DataFrame:
    """Spans (a, c, spans) of contents (a, c, n, off, bytes), by counts of fingerprints."""
    blocks = written(_blocks(contents, width), "substr-blocks")
    # blocks of the same bytes are one kind; one of them stands for all
    kinds = written(blocks.groupBy("h", "u1", "u2").agg(F.count("*").alias("k"), F.min(F.struct("a", "c", "lo", "hi")).alias("r")), "substr-kinds")
    whole = blocks.join(kinds.where("k > 1").select("h", "u1", "u2"), ["h", "u1", "u2"], "left_semi").select("a", "c", F.col("lo").alias("s"), (F.col("hi") + width).alias("e"))
    unlike = kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    open_ = written(kinds.join(unlike, "h", "left_semi").select("k", "r.*"), "substr-open")
    windows = written(_windows(open_.join(contents.select("a", "c", "bytes"), ["a", "c"]), width), "substr-windows")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("t")).where("t > 1").select("h1", "h2")
    single = windows.where("k = 1").join(again, ["h1", "h2"], "left_semi").select("a", "c", F.col("r").alias("s"), (F.col("r") + width).alias("e"))
    return whole.unionByName(single).groupBy("a", "c").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def repeated_spans(docs: DataFrame, text: str = "text", width: int = WIDTH, seed: int = SEED, most: int = MOST_CONTENTS) -> DataFrame:
    """_d, _t (row_keys of docs) and spans, the byte ranges of repeated strings within runs; they may touch and overlap."""
    spark = docs.sparkSession
    keyed = row_keys(docs, text).select("_d", "_t", F.col(text).cast("binary").alias("_x"))
    long_ = keyed.where(F.octet_length("_x") >= width)
    runs = written(_runs(long_, width, seed), "substr-runs")
    # written, so that the join's sides are both shuffled for it and Spark can split the partition of a frequent anchor
    twice = written(runs.where("k > 0").groupBy("a").agg(F.sum("k").alias("k")).where("k > 1").select("a"), "substr-twice")
    own = written(runs.where("k = 0").select("_d", "_t", F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))).alias("spans")), "substr-own")
    all_runs, runs = runs, written(runs.where("k > 0").join(twice, "a"), "substr-shared")
    discard(all_runs, twice)

    contents = runs.groupBy("a", "c").agg(F.sum("k").alias("times"), F.min(F.struct("_d", "_t", "start", "n", "off")).alias("r"))
    contents = written(contents, "substr-contents")
    sizes = written(contents.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "substr-sizes")
    wanted = contents.join(sizes, "a").select("a", "c", "m", "r.*")
    per_doc = wanted.groupBy("_d", "_t").agg(F.collect_list(F.struct("a", "c", "m", "start", "n", "off")).alias("w"))
    fetched = keyed.join(per_doc, ["_d", "_t"]).select(
        F.explode(F.transform("w", lambda w: F.struct(w["a"].alias("a"), w["c"].alias("c"), w["m"].alias("m"), w["n"].alias("n"), w["off"].alias("off"), F.substring("_x", w["start"] + 1, w["n"] + width - 1).alias("bytes")))).alias("v")
    )
    fetched = written(fetched.select("v.*"), "substr-bytes")
    discard(sizes)

    few = fetched.where(F.col("m") <= most).withColumn("lead", F.expr(f"substring(bytes, off + 1, {seed})"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = few.repartitionByRange(parts, "lead", "a").sortWithinPartitions("lead", "a")
    found = _compared(ranged, width, seed)

    across = _counted(fetched.where(F.col("m") > most), width)

    whole = contents.where("times > 1").select("a", "c", F.array(F.struct(F.lit(0).alias("s"), (F.col("r.n") + width - 1).alias("e"))).alias("spans"))
    all_ = whole.unionByName(found).unionByName(across)
    placed = runs.join(all_, ["a", "c"]).select("_d", "_t", F.transform("spans", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["e"] + F.col("start")).alias("e"))).alias("spans"))
    return placed.unionByName(own).groupBy("_d", "_t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of text without the spans, and these merged to maximal runs."""
    merged: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    left, at = [], 0
    for s, e in merged:
        left.append(text[at:s])
        at = e
    return b"".join([*left, text[at:]]), [tuple(m) for m in merged]


def remove_repeated(docs: DataFrame, text: str = "text", width: int = WIDTH, seed: int = SEED, most: int = MOST_CONTENTS) -> DataFrame:
    """docs with removed array<struct<s,e>> (maximal runs of bytes) and kept (the remaining bytes, which may cut a character).

    Null and empty texts, and those shorter than width, keep all. Rows that repeat id and text are documents each, so their
    text repeats. Matches never cross documents. Columns named removed and kept are replaced.
    """
    cols = [c for c in docs.columns if c not in ("removed", "kept")]
    spans = repeated_spans(docs, text, width, seed, most).select(F.col("_d").alias("_e"), F.col("_t").alias("_u"), F.col("spans").alias("_spans"))
    keyed = row_keys(docs, text)
    joined = keyed.join(spans, (F.col("_d") == F.col("_e")) & (F.col("_t") == F.col("_u")), "left")

    @F.pandas_udf("struct<removed:array<struct<s:int,e:int>>,kept:binary>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [(b"", []) if x is None else _cut(bytes(x), s) for x, s in zip(texts, spans, strict=True)]
        return pd.DataFrame({"removed": [[{"s": s, "e": e} for s, e in m] for _, m in out], "kept": [k for k, _ in out]})

    # only texts with something to remove go to Python
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    done = joined.withColumn("_c", cut(F.when(F.col("_spans").isNotNull(), raw), F.coalesce("_spans", F.array().cast("array<struct<s:int,e:int>>"))))
    return done.select(*cols, F.coalesce("_c.removed", F.array().cast("array<struct<s:int,e:int>>")).alias("removed"), F.when(F.col("_spans").isNotNull(), F.col("_c.kept")).otherwise(raw).alias("kept"))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 200 bytes that start anywhere else too."""
    out = remove_repeated(load(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
