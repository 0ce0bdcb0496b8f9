"""Near-duplicates by Order MinHash (Marcais et al., 2019).

A document is its words; its k-mers are SHINGLE words, each labelled with how often it occurred before. For each of SKETCHES
hash functions, the PICKED k-mers of least hash are kept in the order of the text, so a sketch matches where both content
and order do. Documents that share a sketch meet in a bucket. A pair counts if the edit similarity of its words, from an
alignment within the band that LEAST allows, is at least LEAST.

1. Every document is compared with the first member of each of its buckets (at most SKETCHES pairs a document), which links
   nearly all copies; classes are the components of the links.
2. A bucket is open if its members are of two classes or more: unlike texts that share a passage, or families near the limit.
   Members of small ones are all compared. In large ones that would grow with the square of the bucket, but two texts that are alike share many of their word pairs and
   triples (each edit spoils two or three at most), so they share one among the rarest of either; only such texts are compared,
   which loses none that the limit allows. Those that many documents have, as in a shared passage, never count as rare.

Texts of at most BRIEF words, which have few k-mers, are sketched by single words in the same way. So any two documents that share a
bucket have been compared, are of one class, or can't be alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Rolling, as_bytes, bounded_batches, discard, forget_models, load, mixed, slices, written

SHINGLE, PICKED, SKETCHES, LEAST = 3, 2, 48, 0.8
#: Texts of so many words and fewer are sketched by single words instead, labelled likewise: one edit of five words spoils every k-mer of
#: three. Texts of BOTH to BRIEF words have both sketches, so that any two within a link of BOTH / BRIEF or more have one kind in common.
BOTH, BRIEF, BRIEF_PICKED, BRIEF_SKETCHES = 20, 37, 3, 40
#: Members of an open bucket that are all compared; what they make is at most half as many pairs a row. Larger ones go by rare words.
SMALL = 32
#: Words up to which rare pairs of words are looked at, and from which rare triples are: two long texts share some rare pair by chance.
LONG = 400
#: Counters of word pairs and triples by hash, by which rare ones are told from common ones (a table of fixed size that every task holds),
#: longs of the bits that stand for a text's words, and to how many those are folded that go with each of its small buckets.
SLOTS, WORDS64, FOLDED = 1 << 20, 64, 16
#: Bits of the table by which most texts that are in no pair are told without a shuffle (of fixed size, 2 MB, that every task holds).
PICKS = 1 << 24
#: Pairs that one copy of a text serves; a text in more pairs is joined in as many copies as that takes.
PAIRS_A_COPY = 500


def plain(text: Column) -> Column:
    """Lower-case letters and digits, everything else as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


# --- sketches -------------------------------------------------------------------------------------------------------


def _word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between single blanks start and end."""
    blank = np.concatenate([[True], data == 32, [True]])
    edge = np.diff(blank.astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another; of each text, its first word's place and how many it has."""
    data, bounds = as_bytes(column)
    n = len(bounds) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # a blank between texts, so that words end with their text
    data = np.insert(data, bounds[1:-1], 32)
    bounds = bounds + np.concatenate([np.arange(n), [n - 1]])
    s, e = _word_bounds(data)
    first = np.searchsorted(s, bounds[:-1])
    return Rolling(data).of(s, e), first, np.diff(np.append(first, len(s)))


def _kmers(words: np.ndarray, first: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers of `size` words of all texts, each labelled with how often it occurred before in its text; their texts; and how
    many each text has. A text of fewer words than that is one k-mer."""
    per = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), per)
    at = first[doc] + np.arange(len(doc)) - (np.cumsum(per) - per)[doc]
    grams = np.zeros(len(doc), U64)
    short = counts[doc] < size
    for j in range(size):
        more = words[np.minimum(at + j, len(words) - 1)] if len(doc) else words[:0]
        if short.any():
            more = np.where(short & (j >= counts[doc]), U64(0), more)
        grams = mixed(grams * U64(3) + more + U64(j + 1))
    order = np.lexsort((grams, doc))
    sorted_ = grams[order]
    same = np.concatenate([[False], (sorted_[1:] == sorted_[:-1]) & (doc[order][1:] == doc[order][:-1])]) if len(doc) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    nth = np.empty(len(doc), np.int64)
    nth[order] = np.arange(len(doc)) - begin
    return mixed(grams + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), doc, per


def sketch_batch(column: pa.Array, shingle: int = SHINGLE, picked: int = PICKED, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Of texts as plain() leaves them: words of each, and an array of sketches (rows of texts without words are 0)."""
    words, first, counts = _words_of(column)
    out = np.zeros((len(counts), sketches), np.int64)
    if not len(words):
        return counts, out
    grams, _, per = _kmers(words, first, counts, shingle)
    has = np.flatnonzero(per)
    start = (np.cumsum(per) - per)[has]
    bits = 24 if len(grams) < 1 << 24 else 32  # a k-mer's place, in the low bits of its hash
    place, high, none = np.arange(len(grams), dtype=U64), ~U64((1 << bits) - 1), ~U64(0)
    h = np.empty_like(grams)
    for k in range(sketches):
        salt = mixed(np.array([k + 1], U64))[0]
        np.multiply(grams ^ salt, salt | U64(1), out=h)
        h ^= h >> U64(31)
        h *= U64(0x94D049BB133111EB)
        h &= high
        h |= place
        hits = []
        for _ in range(picked):
            least = np.minimum.reduceat(h, start)
            at = (least & ~high).astype(np.int64)
            # a text with fewer k-mers than are picked has only the end mark left
            gone = least == none
            h[at[~gone]] = none
            hits.append(np.where(gone, np.iinfo(np.int64).max, at))
        total = np.full(len(has), k + 1, U64)
        for at in np.sort(np.stack(hits), axis=0):
            gone = at == np.iinfo(np.int64).max
            total = mixed(total * U64(3) + np.where(gone, U64(0), grams[np.where(gone, 0, at)]))
        out[has, k] = total.view(np.int64)
    return counts, out


def sketch_rows(column: pa.Array, shingle: int = SHINGLE, picked: int = PICKED, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sketches of texts as plain() leaves them, a row each: bucket, place of the text, and its words."""
    n = np.where(pc.binary_length(column).to_numpy(zero_copy_only=False) == 0, 0, pc.count_substring(column, " ").to_numpy(zero_copy_only=False) + 1)
    parts = []
    for chosen, options, mark in ((n <= BRIEF, (1, BRIEF_PICKED, BRIEF_SKETCHES), 1), (n >= BOTH, (shingle, picked, sketches), 0)):
        at = np.flatnonzero(chosen & (n > 0))
        counts, found = sketch_batch(column.take(pa.array(at)), *options)
        parts.append((found.ravel() ^ mark, np.repeat(at, options[2]), np.repeat(counts, options[2])))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sketched(words: DataFrame, shingle: int, picked: int, sketches: int) -> DataFrame:
    """(bucket, _id, n_words): every sketch of every text of words (_id, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_models()  # no model is needed here, and workers may hold that of a stage before
        for batch in slices(batches, 1, 1 << 19):
            bucket, at, counts = sketch_rows(batch.column(1), shingle, picked, sketches)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0).take(pa.array(at)), pa.array(counts.astype(np.int32))], names=["bucket", "_id", "n_words"])

    return words.select("_id", "words").mapInArrow(run, "bucket bigint, _id bigint, n_words int")


# --- verification ---------------------------------------------------------------------------------------------------


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is over `most`; only cells within `most` of the diagonal are
    computed, a column at a time, as bits of one integer (Hyyro, 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    same = 0  # what both end with costs nothing
    while same < len(b) and a[-1 - same] == b[-1 - same]:
        same += 1
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not b:
        return len(a)
    if most == 0:
        return 1
    most = min(most, len(a))
    m, width = len(a), 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    # bit b of a column j is row j - most + b; rows above the first have no vertical step
    vp = ((1 << (most + 1)) - 1) << (width - most - 1)
    vn, score = 0, most
    low = most + 1 - width
    bottom = most  # the lowest row of the band in the column before
    row_bit = top >> 1
    for x in b:
        eq = places.get(x, 0)
        eq = (eq << -low if low < 0 else eq >> low) & mask
        low += 1
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = vn | (~(d0 | vp) & mask)
        hn = d0 & vp
        if bottom < m:
            score += not d0 & top
            bottom += 1
        else:
            score += bool(hp & row_bit) - bool(hn & row_bit)
            row_bit >>= 1
        shifted = d0 >> 1
        vp = hn | (~(shifted | hp) & mask)
        vn = shifted & hp
    return score if score <= most else most + 1


def similar(a: list, b: list, least: float = LEAST) -> bool:
    """Whether 1 - distance / longer length is at least `least`."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # words that the two don't share must each be edited, so this many edits are needed at least
    ca, cb = Counter(a), Counter(b)
    if longer - sum((ca & cb).values()) > most:
        return False
    if a == b:
        return True
    start = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        start += 1
    return banded_distance(a[start:], b[start:], most) <= most


# --- pairs ----------------------------------------------------------------------------------------------------------


def _most(longer: Column, least: float) -> Column:
    """Edits that similar() allows."""
    return F.floor(F.lit(1 - least) * longer + F.lit(1e-9))


def _told(words: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of words whose _id is in ids, and few others: those whose bit some id has. Nothing is shuffled."""
    slot = F.pmod("_id", F.lit(PICKS))
    table = ids.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("b")).toArrow()
    size = 1 << 12  # bytes of one of Spark's bitmaps; the first, of slot 0, has number 0 and bit 0
    bits = np.zeros((PICKS // 8 // size + 1, size), np.uint8)
    for k, b in zip(table.column("k").to_pylist(), table.column("b").to_pylist(), strict=True):
        bits[k] = np.frombuffer(b, np.uint8)
    told = words.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may(bucket: pd.Series, bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        return pd.Series((told.value[bucket.to_numpy(), at >> 3] >> (at & 7) & 1).astype(bool))

    return words.where(may(F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)))


def _picked(words: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of words whose _id is in ids; what is shuffled is little more than these."""
    return _told(words, ids).join(ids, "_id", "left_semi")


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Those of pairs (_id, leader) that are similar; words: _id, words. Texts in no pair aren't shuffled. A text in many pairs is copied, so
    that no task has all of them."""

    @F.pandas_udf("boolean")
    def ok(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x.split(" "), y.split(" "), least) for x, y in zip(a, b, strict=True)])

    met, sides = pairs, (("leader", "_id", "_b", "_k"), ("_id", "leader", "_a", "_c"))
    ids = written(pairs.select("_id").unionByName(pairs.select(F.col("leader").alias("_id"))).distinct(), "omh-ids")
    needed = written(_told(words, ids), "omh-needed")  # the joins below leave out what no pair has
    copies = {side: written(pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("_n")), "omh-copies") for side, *_ in sides}
    for side, other, _, at in sides:  # which copy serves a pair, while the pairs are narrow
        many = copies[side].where("_n > 1")
        met = met.join(many, side, "left").withColumn(at, F.pmod(F.xxhash64(other), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    for side, _, text, at in sides:
        each = needed.select(F.col("_id").alias(side), F.col("words").alias(text)).join(copies[side], side)
        met = met.join(each.select(side, text, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(at)), [side, at])
    found = written(met.where(ok("_a", "_b")).select("_id", "leader"), "omh-links")
    discard(ids, needed, *copies.values())
    return found


def _first_met(buckets: DataFrame, least: float) -> DataFrame:
    """(_id, leader): each text and the first of every bucket it is in, once each, if their lengths allow a link."""
    first = buckets.groupBy("bucket").agg(F.min(F.struct("_id", "n_words")).alias("f")).select("bucket", F.col("f._id").alias("leader"), F.col("f.n_words").alias("_w"))
    met = buckets.join(first, "bucket").where("_id <> leader")
    return met.where(F.abs(F.col("n_words") - F.col("_w")) <= _most(F.greatest("n_words", "_w"), least)).select("_id", "leader").distinct()


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, _id, class, small) of the buckets whose members are of two classes or more; small: whether it has SMALL of them at most."""
    labelled = buckets.select("bucket", "_id").join(found.select("_id", "class"), "_id")
    mixed_ = labelled.groupBy("bucket").agg(F.min("class").alias("_a"), F.max("class").alias("_b"), F.count("*").alias("_n")).where("_a <> _b")
    return labelled.join(mixed_.select("bucket", (F.col("_n") <= SMALL).alias("small")), "bucket")


def _small_grams(words: np.ndarray, first: np.ndarray, counts: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of words of the texts up to LONG, and triples of those that may be alike with a longer one: size, k-mers, their texts, and
    how many each of those has (a text of one word is one k-mer). Two texts within the link have one of the two kinds both."""
    for size, of in ((2, counts <= LONG), (3, counts >= least * LONG - 1)):
        at = np.flatnonzero(of & (counts > 0))
        grams, doc, per = _kmers(words, first[at], counts[at], size)
        yield size, grams, at[doc], per


def _gram_counts(words: DataFrame, least: float) -> np.ndarray:
    """How many word pairs and triples of all texts (words) fall on each of SLOTS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, 0, 1 << 20):
            for _, grams, _, _ in _small_grams(*_words_of(batch.column(0)), least):
                total += np.bincount((grams % U64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "n"])

    sums = words.select("words").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out


def rare_grams(column: pa.Array, common: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as plain() leaves them: the rarest word pairs or triples of each, so many that two texts of similarity `least` share one
    among them; the text of each; and the one before it in the order of rarity (0 for the first)."""
    words, first, counts = _words_of(column)
    found = []
    for size, grams, doc, per in _small_grams(words, first, counts, least):
        if not len(grams):
            continue
        grams = grams[np.lexsort((grams, common[(grams % U64(SLOTS)).astype(np.int64)], doc))]
        rank = np.arange(len(grams)) - np.repeat(np.cumsum(per) - per, per)
        before = np.where(rank > 0, np.concatenate([[U64(0)], grams[:-1]]), U64(0))
        # an edit spoils `size` of them at most, so a text of n words and one within the allowed edits of it share this many or more
        need = np.maximum(1, np.ceil((1 - size * (1 - least)) * counts - (size - 1) - 1e-6).astype(np.int64))
        keep = rank < np.repeat(per, per) - need[doc] + 1
        found.append((grams[keep], doc[keep], before[keep]))
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_bits(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of texts as plain() leaves them: how many words each has, and for each bit of WORDS64 longs whether the words that fall on it,
    each labelled with how often it occurred before, are odd in number."""
    words, first, counts = _words_of(column)
    size = WORDS64 * 64
    bits = np.zeros(len(counts) * size, np.uint8)
    if len(words):
        grams, doc, _ = _kmers(words, first, counts, 1)
        np.bitwise_xor.at(bits, doc * size + (grams % U64(size)).astype(np.int64), 1)
    return counts, np.packbits(bits).view(np.int64).reshape(len(counts), WORDS64)


def signed(column: pa.Array) -> list[pa.Array]:
    """Of texts as plain() leaves them: words, and FOLDED longs of word_bits(); what falls on one bit of those is odd in number again."""
    counts, bits = word_bits(column)
    folded = np.bitwise_xor.reduce(bits.reshape(len(counts), -1, FOLDED), axis=1)
    return [pa.array(counts), *(pa.array(np.ascontiguousarray(folded[:, k])) for k in range(FOLDED))]


def _may_be_alike(words: DataFrame, open_: DataFrame, least: float) -> DataFrame:
    """(_id, leader, class, other, gap), as _met() has them: pairs of open_ (bucket, _id, class, small) in different classes that share a
    small bucket, or are in large ones and share a rare pair or triple of words. words: _id, words."""
    if least < 0.75:
        raise ValueError("pairs and triples of words only bound similarities of 0.75 and more")
    members = open_.groupBy("_id", "class").agg(F.bool_and("small").alias("small"))
    texts = written(words.join(members, "_id").select("_id", "class", "words", "small"), "omh-open")
    large = texts.where("not small").select("_id", "class", "words")
    common = words.sparkSession.sparkContext.broadcast(_gram_counts(large, least))  # SLOTS numbers

    signs = [f"w{k}" for k in range(FOLDED)]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), *signed(batch.column(1))], names=["_id", "n", *signs])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            counts, bits = word_bits(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * WORDS64), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), lists], names=["_id", "n", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            grams, doc, before = rare_grams(batch.column(2), common.value, least)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(grams.view(np.int64)), pa.array(before.view(np.int64))], names=["_id", "class", "g", "b"])

    rare = written(large.mapInArrow(run, "_id bigint, class bigint, g bigint, b bigint"), "omh-rare")
    met = _parting(rare).join(large.select("_id", "words").mapInArrow(whole, "_id bigint, n bigint, w array<bigint>"), "_id")
    rows = written(met, "omh-shared")
    of = "n bigint, " + ", ".join(f"{w} bigint" for w in signs)
    small = open_.where("small").join(texts.select("_id", "words").mapInArrow(told, f"_id bigint, {of}"), "_id")
    small = written(small.select("_id", "class", "n", *signs, F.col("bucket").alias("g"), F.lit(0).cast("long").alias("b")), "omh-small")
    folded = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in signs), F.lit(0))
    each = F.zip_with("x.w", "y.w", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    pairs = _met(rows, F.aggregate(each, F.lit(0), lambda a, b: a + b), least).unionByName(_met(small, folded, least))
    pairs = pairs.groupBy("_id", "leader").agg(F.first("class").alias("class"), F.first("other").alias("other"), F.max("gap").alias("gap"))
    pairs = written(pairs, "omh-pairs")
    discard(texts, rare, rows, small)
    return pairs


def _parting(rare: DataFrame) -> DataFrame:
    """The rows of rare (_id, class, g, b) whose g can bring two texts together for the first time: texts of two classes have it, and not all
    of them have the same one before it (where these have met) or it is the first of one. So a passage that a family of texts shares is left
    with the few of its pairs and triples where their orders part."""
    seen = rare.groupBy("g").agg(F.min("class").alias("_a"), F.max("class").alias("_z"), F.min("b").alias("_f"), F.max("b").alias("_l"), F.max(F.col("b") == 0).alias("_o"))
    return rare.join(seen.where("_a <> _z and (_f <> _l or _o)").select("g"), "g", "left_semi")


def _met(rows: DataFrame, odd: Column, least: float) -> DataFrame:
    """(_id, leader, class, other, gap): pairs of rows (_id, class, n, g, b and bits) of different classes that meet in g, if lengths and bits
    allow a link; gap: how far the bits are from forbidding it, at most 0. odd: in how many bits x and y differ."""
    x, y = rows.alias("x"), rows.alias("y")
    # two texts that share the one before this too have met there
    new = (F.col("x.g") == F.col("y.g")) & (F.col("x._id") > F.col("y._id")) & (F.col("x.class") != F.col("y.class")) & ((F.col("x.b") != F.col("y.b")) | (F.col("x.b") == 0))
    apart, most = F.abs(F.col("x.n") - F.col("y.n")), _most(F.greatest("x.n", "y.n"), least)
    # a word that only one of two texts has is an edit, or half of one; bits differ by no more than words do, so no link is lost
    over = odd + apart - 2 * most
    met = x.join(y, new & (apart <= most) & (over <= 0))
    return met.select(F.col("x._id").alias("_id"), F.col("y._id").alias("leader"), F.col("x.class").alias("class"), F.col("y.class").alias("other"), over.alias("gap"))


# --- classes --------------------------------------------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(_id, class, n_links): the least id that edges (_id, leader) connect a node with, and its edges. Labels spread along the
    edges and jump to their label's label; every round is a table in the shared folder. A component that has one label is done and leaves, so
    a round has the edges of the others only."""
    both = edges.select("_id", "leader").unionByName(edges.select(F.col("leader").alias("_id"), F.col("_id").alias("leader"))).distinct()
    # with each node its own neighbour, one join and one minimum make a round
    own = both.select("_id").distinct().select("_id", F.col("_id").alias("leader"))
    every = around = written(both.unionByName(own), "omh-edges")
    labels, done = written(around.groupBy("_id").agg(F.min("leader").alias("class")), "omh-labels"), []
    while True:
        near = around.join(labels.select(F.col("_id").alias("leader"), "class"), "leader").groupBy("_id")
        near = written(near.agg(F.min("class").alias("class"), F.max("class").alias("_top"), F.max(F.when(F.col("_id") == F.col("leader"), F.col("class"))).alias("_own")), "omh-near")
        # a component of several labels has an edge out of each of them
        mixed_ = written(near.where("class <> _top").select("_own").distinct(), "omh-mixed")
        done.append(written(near.join(mixed_, "_own", "left_anti").select("_id", "class"), "omh-done"))
        was, more = (labels, mixed_), mixed_.limit(1).count()
        if more:
            left = near.join(mixed_, "_own", "left_semi").select("_id", "class")
            jump = left.select(F.col("_id").alias("class"), F.col("class").alias("_j"))
            labels = written(left.join(jump, "class").select("_id", F.col("_j").alias("class")), "omh-labels")
            before, around = around, written(around.join(labels, "_id", "left_semi"), "omh-edges")
            if before is not every:
                discard(before)
        discard(near, *was)
        if not more:
            break
    degree = every.where("_id <> leader").groupBy("_id").agg(F.count("*").alias("n_links"))
    known = reduce(DataFrame.unionByName, done).join(degree, "_id")
    return nodes.join(known, "_id", "left").select("_id", F.coalesce("class", "_id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """found (_id, class, n_links) with further edges (_id, leader), each once, between its classes: only these classes are connected anew."""
    of = found.select("_id", "class")
    ends = more.join(of, "_id").select(F.col("class").alias("_a"), F.col("leader").alias("_id")).join(of, "_id")
    edges = written(ends.select(F.col("_a").alias("_id"), F.col("class").alias("leader")).distinct(), "omh-between")
    nodes = edges.select("_id").unionByName(edges.select(F.col("leader").alias("_id"))).distinct()
    top = components(nodes, edges).select(F.col("_id").alias("class"), F.col("class").alias("_top"))
    new = more.select(F.explode(F.array("_id", "leader")).alias("_id")).groupBy("_id").agg(F.count("*").alias("_new"))
    wide = found.join(top, "class", "left").join(new, "_id", "left")
    return wide.select("_id", F.coalesce("_top", "class").alias("class"), (F.col("n_links") + F.coalesce("_new", F.lit(0))).alias("n_links"))


def _linked(found: DataFrame, pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """found (_id, class, n_links) with the links among pairs (_id, leader, class, other, gap). Of each two classes the pair of least gap is
    aligned first; where that links them, no other pair of theirs is needed."""
    best = pairs.groupBy(F.least("class", "other"), F.greatest("class", "other")).agg(F.min(F.struct("gap", "_id", "leader")).alias("f"))
    best = written(best.select("f._id", "f.leader"), "omh-best")
    more = _verified(best, words, least)
    if more.limit(1).count():
        found = written(_merged(found, more), "omh-found")
    of = found.select("_id", "class")
    rest = pairs.select("_id", "leader").join(best, ["_id", "leader"], "left_anti").join(of, "_id")
    rest = rest.join(of.select(F.col("_id").alias("leader"), F.col("class").alias("_c")), "leader").where("class <> _c").select("_id", "leader")
    rest = written(rest, "omh-rest")
    if rest.limit(1).count():
        more = _verified(rest, words, least)
        if more.limit(1).count():
            found = _merged(found, more)
    discard(best, rest)
    return found


def _classes(docs: DataFrame, text: str, shingle: int, picked: int, sketches: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(members, told): members doc_id, _id, _raw of every row; told _id, class, n_links of every different text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col(text).alias("_x"), plain(F.col(text)).alias("_p"))
    keyed = base.select("doc_id", _identity(F.col("_x"), F.col("_p"), F.col("doc_id")).alias("_id"), F.xxhash64("_x").alias("_raw"), "_p")
    members = written(keyed.select("doc_id", "_id", "_raw"), "omh-members")
    # one document stands for all with the same words
    first = members.groupBy("_id").agg(F.min("doc_id").alias("doc_id"))
    words = keyed.where("_p <> ''").join(first, ["_id", "doc_id"], "left_semi").dropDuplicates(["_id", "doc_id"])
    words = written(words.select("_id", F.col("_p").alias("words")), "omh-words")
    every = written(sketched(words, shingle, picked, sketches), "omh-sketches")
    shared = written(every.groupBy("bucket").count().where("count > 1").select("bucket"), "omh-shared")
    buckets = written(every.join(shared, "bucket", "left_semi"), "omh-buckets")
    discard(every, shared)
    nodes = members.select("_id").distinct()
    links = _verified(written(_first_met(buckets, least), "omh-first"), words, least)
    found = components(nodes, links)
    open_ = written(_open(buckets, found), "omh-left")
    if open_.limit(1).count():
        pairs = _may_be_alike(words, open_, least)
        if pairs.limit(1).count():
            found = _linked(found, pairs, words, least)
        discard(pairs)
    discard(buckets, words, open_)
    return members, found


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, picked: int = PICKED, sketches: int = SKETCHES, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size (documents in it) and n_links (links verified between
    the document's text and different ones), a row for each row of docs.

    Two documents are in one class if their words are the same, or if links lead from one to the other. Texts without a word,
    empty ones too, are alike if they are equal; a null text is like no other. Rows that repeat a doc_id are documents of
    their own; a null doc_id counts as -1. Whole texts are compared, however long. Other columns of docs aren't read. Texts are
    told apart by a 64-bit fingerprint of their words. `least` is 0.75 at least.
    """
    members, found = _classes(docs, text, shingle, picked, sketches, least)
    sized = members.groupBy("_id").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_least"))
    classes = found.join(sized, "_id").groupBy("class").agg(F.min("_least").alias("class_id"), F.sum("_n").alias("class_size"))
    told = found.join(classes, "class").select("_id", "class_id", "class_size", "n_links")
    return members.select("doc_id", "_id").join(told, "_id").select("doc_id", "class_id", "class_size", "n_links")


def _identity(text: Column, words: Column, doc_id: Column) -> Column:
    """What makes texts the same: their words, or the text itself if it has none, or nothing if it is null."""
    return F.when(text.isNull(), F.xxhash64(F.lit("null"), doc_id, F.rand(7))).when(words == "", F.xxhash64(F.lit("raw"), text)).otherwise(F.xxhash64(F.lit("words"), words))


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Of each class one row, with the columns of docs: that of the least doc_id (a null one is the largest), and of the texts it
    has in the class one, the same on every run. A doc_id with two unlike texts keeps both. Of rows that repeat doc_id and
    text one stays. Rows whose text is null are like no other and all stay."""
    some = docs.where(F.col(text).isNotNull())
    opts = {"shingle": SHINGLE, "picked": PICKED, "sketches": SKETCHES, "least": LEAST} | options
    # null ids come last
    numbered = some.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col(text).alias("text"))
    members, found = _classes(numbered, "text", **opts)
    first = members.join(found.select("_id", "class"), "_id").groupBy("class").agg(F.min(F.struct("doc_id", "_raw")).alias("f")).select(F.col("f.doc_id").alias("_d"), F.col("f._raw").alias("_r"))
    keyed = some.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_d"), F.xxhash64(text).alias("_r"))
    kept = keyed.join(first, ["_d", "_r"], "left_semi").dropDuplicates(["_d", "_r"])
    return kept.select("_row.*").unionByName(docs.where(F.col(text).isNull()))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document among all documents."""
    return near_duplicates(load(spark, sf_dir, "documents"))
