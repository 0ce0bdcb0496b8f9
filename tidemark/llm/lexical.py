"""Ranked lexical search over dual-sorted wavelet trees (Navarro and Puglisi, 2010), one for each shard of documents.

The postings of a shard, term after term and those of a term by falling impact, are one sequence of document numbers, kept as a
wavelet matrix: a term is a range of it, and going down a level cuts every range into the documents of the lower and of the upper
half, each still by falling impact. So a node is a range of document numbers with a range of postings for each term of an item,
and the first of each range, times the term's weight, bounds what any of its documents can score. Nodes are opened best first, for
many items at once, until no bound can enter an item's top k; a leaf's bound is its score.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, bounded_batches, load, run_hashes, slices, written

K = 20
#: Bytes of text in one shard (a longer text is a shard of its own), and bytes that are cut into terms at once.
SHARD_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Terms of items that one pass over the index takes, with 24 bytes a term in each task; more items are more passes.
BLOCK_TERMS = 1 << 20
#: Items searched side by side in a task, and nodes that each opens in one step.
SIDE_BY_SIDE, OPENED = 256, 24
INDEX = "docs array<long>, levels int, postings long, terms binary, offsets binary, impacts binary, bits binary"

_IS_TERM = np.ones(256, bool)
_IS_TERM[:0x80] = [chr(b).isalnum() for b in range(0x80)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the text's number of every term, in order: maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased. Terms are told apart by 64 bits. Null texts have none."""
    data, bounds = as_bytes(texts)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _IS_TERM[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(inside[:-1] & (first[:-1] | ~np.concatenate([[False], inside[:-2]]))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1 if len(data) else starts
    return run_hashes(_LOWER[data], starts, ends, PIECE_BYTES), np.searchsorted(bounds, starts, side="right") - 1


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in slices(batches, 0):
            of = terms_of(batch.column(0))[1]
            n, terms = n + len(np.unique(of)), terms + len(of)
        yield pa.RecordBatch.from_pydict({"n": [n], "terms": [terms]})

    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(text).alias("text")).mapInArrow(counted, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return found["n"] or 0, found["terms"] or 0


def _shard(ids: np.ndarray, known: np.ndarray, hashes: np.ndarray, of: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """An INDEX row. ids (0 where not known) are those of the texts that `of` numbers."""
    lengths = np.bincount(of, minlength=len(ids))
    order = np.lexsort((ids, ~known))
    order = order[lengths[order] > 0]
    number = np.zeros(len(ids), np.int64)
    number[order] = np.arange(len(order))
    fixed = 100 - 25 + (25 * lengths[order].astype(np.int64) * n_docs) // n_terms
    of = number[of]
    by_doc = np.argsort(of, kind="stable")
    hashes, of = hashes[by_doc], of[by_doc]
    by_term = np.argsort(hashes, kind="stable")
    hashes, of = hashes[by_term], of[by_term]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]))
    tf = np.diff(np.append(new, len(hashes)))
    hashes, of = hashes[new], of[new]
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * fixed[of])
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    offsets = np.append(begin, len(hashes))
    term = np.repeat(np.arange(len(begin)), np.diff(offsets))
    falling = np.argsort((term << 20) | ((1 << 20) - 1 - impact), kind="stable")  # impacts are under 10**6
    of, impact = of[falling], impact[falling]
    levels, bits = max(1, (len(order) - 1).bit_length()), []
    for level in range(levels - 1, -1, -1):
        upper = (of >> level & 1).astype(bool)
        bits.append(np.packbits(upper).tobytes())
        of = np.concatenate([of[~upper], of[upper]])
    docs = [int(i) if k else None for i, k in zip(ids[order], known[order], strict=True)]
    return {"docs": docs, "levels": levels, "postings": len(of), "terms": hashes[begin].tobytes(), "offsets": offsets.astype(np.int32).tobytes(), "impacts": impact.astype(np.int32).tobytes(), "bits": b"".join(bits)}


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """INDEX rows of all documents with a term, a row a shard, written in the shared folder. Texts are read twice and never shuffled.

    Every row is a document: repeated rows and ids, and null ids, are several. Other columns aren't read. An empty table, and one
    without terms, gives an index without rows.
    """
    n_docs, n_terms = totals(docs, text)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, hashes, of, held, n = [], [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            row = _shard(np.concatenate(ids), np.concatenate(known), np.concatenate(hashes), np.concatenate(of), n_docs, n_terms)
            return pa.RecordBatch.from_pydict({c: [v] for c, v in row.items()}, schema=schema)

        for batch in slices(batches, 1):
            some, at = terms_of(batch.column(1))
            if not len(some):
                continue
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            known.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            hashes.append(some)
            of.append((at + n).astype(np.int32))
            n += batch.num_rows
            held += batch.column(1).nbytes
            if held >= shard_bytes:
                yield shard()
                ids, known, hashes, of, held, n = [], [], [], [], 0, 0
        if hashes:
            yield shard()

    schema = pa.schema({"docs": pa.list_(pa.int64()), "levels": pa.int32(), "postings": pa.int64(), "terms": pa.binary(), "offsets": pa.binary(), "impacts": pa.binary(), "bits": pa.binary()})
    bounded_batches(docs.sparkSession)
    out = written(docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("x")).mapInArrow(indexed, INDEX), "lexical-index")
    out._n_docs = n_docs
    return out


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, _item, hash, times): the distinct terms of each item. Rows that repeat an id and a text are one item, named _item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            hashes, of = terms_of(batch.column(2))
            pairs, times = np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1, return_counts=True)
            row = pa.array(pairs[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(pairs[1].view(np.int64)), pa.array(times.astype(np.int64))], ["item_id", "_item", "hash", "times"])

    rows = items.select(F.col(item_id).alias("item_id"), F.xxhash64(item_id, text).alias("_item"), F.col(text).alias("x")).dropDuplicates(["item_id", "_item"])
    return rows.mapInArrow(cut, f"item_id {items.schema[item_id].dataType.simpleString()}, _item long, hash long, times long")


class Queries:
    """Items as arrays: of each item its terms, by place in the sorted distinct hashes, with weight times repeats."""

    def __init__(self, rows: list, n_docs: int, df: dict[int, int]):
        some = [r for r in rows if r["hash"] in df]
        weight = {h: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for h, n in df.items()}
        names = sorted({(r["_item"], r["item_id"]) for r in some}, key=lambda x: x[0])
        place = {item: i for i, (item, _) in enumerate(names)}
        self.items = names
        self.hashes = np.unique(np.array([r["hash"] for r in some], np.int64).view(np.uint64))
        item = np.array([place[r["_item"]] for r in some], np.int64)
        order = np.argsort(item, kind="stable")
        self.item = item[order]
        self.term = np.searchsorted(self.hashes, np.array([r["hash"] for r in some], np.int64).view(np.uint64))[order]
        self.weight = np.array([weight[r["hash"]] * r["times"] for r in some], np.int64)[order]


class Top:
    """The k best (score, then doc_id, unknown last) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item, self.score, self.doc, self.known = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least, self.last = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        item, score, doc, known = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, ~known, -score, item))
        order = order[_ranks(item[order]) < self.k]
        self.item, self.score, self.doc, self.known = item[order], score[order], doc[order], known[order]
        full = np.bincount(self.item, minlength=self.items) == self.k
        at = np.cumsum(np.bincount(self.item, minlength=self.items)) - 1
        self.least[full] = self.score[at[full]]
        self.last[full] = np.where(self.known[at[full]], self.doc[at[full]], np.iinfo(np.int64).max)

    def open(self, item: np.ndarray, bound: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
        """Which nodes can hold a document that enters: by bound, and at the same score by the least doc_id."""
        return (bound > self.least[item]) | ((bound == self.least[item]) & (bound > 0) & (first_doc < self.last[item]))


def _ranks(sorted_: np.ndarray) -> np.ndarray:
    """Places within runs of equal values."""
    at = np.arange(len(sorted_))
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(sorted_) else at


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Shard:
    """A row of the index with ranks and impacts of every level, ready to be searched."""

    def __init__(self, row: dict):
        n, self.levels = row["postings"], row["levels"]
        self.docs = np.array([0 if d is None else d for d in row["docs"]], np.int64)
        self.known = np.array([d is not None for d in row["docs"]])
        self.terms, self.offsets = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["offsets"], np.int32)
        bits = np.frombuffer(row["bits"], np.uint8).reshape(self.levels, -1)
        self.width = n + 1
        self.ones, self.impacts = np.zeros((self.levels, n + 1), np.int32), np.zeros((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n] = np.frombuffer(row["impacts"], np.int32)
        for level in range(self.levels):
            upper = np.unpackbits(bits[level], count=n).view(bool)
            np.cumsum(upper, out=self.ones[level, 1:])
            below, zeros = self.impacts[level, :n], n - int(self.ones[level, -1])
            self.impacts[level + 1, :zeros], self.impacts[level + 1, zeros:n] = below[~upper], below[upper]
        self.zeros = n - self.ones[:, -1].astype(np.int64)
        self._ones, self._impacts = self.ones.ravel(), self.impacts.ravel()

    def first_doc(self, level: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = np.minimum(code << (self.levels - level), len(self.docs) - 1)
        return np.where(self.known[at], self.docs[at], np.iinfo(np.int64).max - 1)

    def search(self, q: Queries, items: slice, top: Top) -> None:
        """Adds to top what this shard has for some of the items."""
        lo, hi = np.searchsorted(q.item, [items.start, items.stop])
        at = np.minimum(np.searchsorted(self.terms, q.hashes), len(self.terms) - 1)
        there = self.terms[at] == q.hashes
        pick = np.arange(lo, hi)[there[q.term[lo:hi]]]
        left, right, weight, owner = self.offsets[at[q.term[pick]]].astype(np.int64), self.offsets[at[q.term[pick]] + 1].astype(np.int64), q.weight[pick], q.item[pick]
        item, count = np.unique(owner, return_counts=True)
        nodes = self._bounded(item, np.zeros(len(item), np.int64), np.zeros(len(item), np.int64), count, left, right, weight, top)
        while len(nodes[0]):
            item, level, code, bound, start, count, left, right, weight = nodes
            order = np.lexsort((-bound, item))
            chosen = np.zeros(len(item), bool)
            chosen[order[_ranks(item[order]) < OPENED]] = True
            pairs = _spread(start[chosen], count[chosen])
            opened = self._open(item[chosen], level[chosen], code[chosen], count[chosen], left[pairs], right[pairs], weight[pairs], top)
            rest = ~chosen
            rest[rest] = top.open(item[rest], bound[rest], self.first_doc(level[rest], code[rest]))
            kept = _spread(start[rest], count[rest])
            some = [np.concatenate(x) for x in zip((item[rest], level[rest], code[rest], bound[rest], count[rest], left[kept], right[kept], weight[kept]), (opened[0], opened[1], opened[2], opened[3], *opened[5:]), strict=True)]
            item, level, code, bound, count, left, right, weight = some
            nodes = item, level, code, bound, np.cumsum(count) - count, count, left, right, weight

    def _open(self, item, level, code, count, left, right, weight, top: Top) -> tuple:
        """The two halves of each node."""
        of = np.repeat(level, count)
        ones_left, ones_right = self._ones[of * self.width + left].astype(np.int64), self._ones[of * self.width + right].astype(np.int64)
        zeros = self.zeros[of]
        both = (np.concatenate(x) for x in ((item, item), (level + 1, level + 1), (code * 2, code * 2 + 1), (count, count), (left - ones_left, zeros + ones_left), (right - ones_right, zeros + ones_right), (weight, weight)))
        return self._bounded(*both, top)

    def _bounded(self, item, level, code, count, left, right, weight, top: Top) -> tuple:
        """Nodes with their bounds, without empty ranges and without nodes that can't enter; leaves go to top instead."""
        node = np.repeat(np.arange(len(item)), count)
        some = right > left
        node, left, right, weight = node[some], left[some], right[some], weight[some]
        bound = np.bincount(node, weights=self._impacts[level[node] * self.width + left] * weight, minlength=len(item)).astype(np.int64)  # exact below 2**53
        live = top.open(item, bound, self.first_doc(level, code))
        leaf = live & (level == self.levels)
        if leaf.any():
            top.add(item[leaf], bound[leaf], self.docs[code[leaf]], self.known[code[leaf]])
            live &= ~leaf
        count = np.bincount(node, minlength=len(item))[live]
        kept = live[node]
        return item[live], level[live], code[live], bound[live], np.cumsum(count) - count, count, left[kept], right[kept], weight[kept]


def _frequencies(index: DataFrame, rows: list) -> dict[int, int]:
    """Of each term of rows that the index has, its documents; at most one entry a term goes to the driver."""
    hashes = np.unique(np.array([r["hash"] for r in rows], np.int64).view(np.uint64))
    wanted = index.sparkSession.sparkContext.broadcast(hashes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for terms, offsets in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                terms = np.frombuffer(terms, np.uint64)
                at = np.minimum(np.searchsorted(terms, wanted.value), len(terms) - 1)
                total += np.where(terms[at] == wanted.value, np.diff(np.frombuffer(offsets, np.int32))[at], 0)
        some = total > 0
        yield pa.RecordBatch.from_pydict({"hash": wanted.value[some].view(np.int64), "n": total[some]})

    found = index.select("terms", "offsets").mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).collect()
    return {r["hash"]: r["n"] for r in found}


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item by score, those of a score by doc_id, null ones last. Exact.

    Items without a term that the index has give no row; documents of score 0 give none. Items go in blocks of BLOCK_TERMS terms,
    each with a pass over the index; a task keeps k documents of each item of its block.
    """
    spark = index.sparkSession
    terms = written(item_terms(items, item_id, text), "lexical-items")
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    name = terms.schema["item_id"].dataType.simpleString()
    out = []
    for block in range(blocks):
        rows = terms.where(F.pmod("_item", F.lit(blocks)) == block).collect()  # about BLOCK_TERMS rows, at least one item's
        queries = spark.sparkContext.broadcast(Queries(rows, index._n_docs, _frequencies(index, rows) if rows else {}))
        out.append(index.mapInArrow(functools.partial(_searched, queries, k), "_at long, doc_id long, score long"))
        names = spark.createDataFrame([(i, item, x) for i, (x, item) in enumerate(queries.value.items)], f"_at long, item_id {name}, _item long")
        out[-1] = out[-1].join(F.broadcast(names), "_at").select("item_id", "_item", "doc_id", "score")
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return functools.reduce(DataFrame.union, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(queries, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q: Queries = queries.value
    top = Top(len(q.items), k)
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.slice(i, 1).to_pylist()[0])
            for at in range(0, len(q.items), SIDE_BY_SIDE):
                shard.search(q, slice(at, at + SIDE_BY_SIDE), top)
    yield pa.RecordBatch.from_arrays([pa.array(top.item), pa.array(top.doc, mask=~top.known), pa.array(top.score)], ["_at", "doc_id", "score"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(build_index(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM p),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM p) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
sc AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN df USING (t) JOIN tf USING (t), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {K}"""
}
