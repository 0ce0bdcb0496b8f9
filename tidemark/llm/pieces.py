"""SentencePiece encoding and decoding as a weighted transducer.

The model is compiled into three parts: a normaliser, a trie transducer from characters to pieces, and byte fallback for
characters that no piece has. Composed with a text they span a lattice of pieces, whose shortest path in the tropical
semiring is the encoding. In a unigram model a piece weighs minus its score. In a BPE model, the arc from one piece to the
next weighs 0 if merging their joined text gives these two pieces again, and infinity if not; a sequence is what merging
gives just if all its neighbours pass, so the one finite path is the exact BPE encoding, and every prefix has one too.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, held_model, load, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments and pairs that a Python worker remembers at most.
MEMO = 100_000


def compile_model(path: str = MODEL) -> dict:
    """What tasks need of a model file, as plain data (about as large as the vocabulary)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rules = proto.normalizer_spec
    # what isn't compiled here is refused: it would give other ids than the library's
    if rules.name != "identity" or rules.precompiled_charsmap:
        raise ValueError(f"normaliser {rules.name} maps characters")
    if proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("white space as a suffix")
    if proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("neither a unigram nor a BPE model")
    if any(p.type == p.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces")
    normal, of_bytes, unknown = {}, {}, 0
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            of_bytes[int(piece[1:-1], 16)] = i
        elif sp.is_unknown(i):
            unknown = i
        elif not sp.is_control(i) and not sp.is_unused(i):
            normal[piece] = (i, sp.get_score(i))
    return {"bpe": proto.trainer_spec.model_type == 2, "prefix": rules.add_dummy_prefix, "squeeze": rules.remove_extra_whitespaces, "pieces": normal, "bytes": of_bytes if len(of_bytes) == 256 else {}, "unknown": unknown, "size": sp.get_piece_size()}


class Transducer:
    def __init__(self, model: dict):
        self.m = model
        self.trie: dict = {}
        for piece, (i, score) in model["pieces"].items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = (piece, i, -score)
        known = sorted({c for p in model["pieces"] for c in p} - {SPACE})
        inside = "".join(re.escape(c) for c in known)
        # no piece goes on past a blank that follows another character, so shortest paths meet there
        apart = not any(SPACE in p.lstrip(SPACE) for p in model["pieces"])
        self.segments = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]", re.DOTALL) if apart and inside else re.compile(".+", re.DOTALL)
        self.floor = max((-s for _, s in model["pieces"].values()), default=0.0) + 10.0
        # nor does any piece hold two characters that stand side by side in none, so a new segment is cut there first
        self.touch = {x + y for p in model["pieces"] for x, y in zip(p, p[1:], strict=False)}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.out = [b""] * model["size"]
        for piece, (i, _) in model["pieces"].items():
            self.out[i] = piece.encode()
        for b, i in model["bytes"].items():
            self.out[i] = bytes([b])
        self.out[model["unknown"]] = " ⁇ ".encode()

    def normal(self, text: str) -> str:
        if self.m["squeeze"]:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.m["prefix"]:
            text = " " + text
        return text.replace(" ", SPACE)

    def _merged(self, text: str) -> list[str]:
        """Pieces by merging: of all neighbours that join to a piece, the best scored and then leftmost, again and again."""
        parts, pieces = list(text), self.m["pieces"]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = pieces.get(parts[k] + parts[k + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fallback(self, ch: str) -> list[int]:
        return [self.m["bytes"][b] for b in ch.encode("utf-8", "replace")] if self.m["bytes"] else [self.m["unknown"]]

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path through the lattice of text."""
        return self._merge_path(text) if self.m["bpe"] else self._score_path(text)

    def _score_path(self, text: str) -> list[int]:
        n, inf = len(text), float("inf")
        cost: list[float] = [0.0] + [inf] * n
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # from, id (-1: fallback)
        for i in range(n):
            here = cost[i]
            if here == inf:
                continue
            node = self.trie
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                end = node.get("")
                if end is not None and here + end[2] < cost[j + 1]:
                    cost[j + 1], came[j + 1] = here + end[2], (i, end[1])
            if text[i] not in self.m["pieces"] and here + self.floor < cost[i + 1]:
                cost[i + 1], came[i + 1] = here + self.floor, (i, -1)
        return self._back(text, came)

    def _merge_path(self, text: str) -> list[int]:
        """Weights are 0 or infinite, so any path that ends is a shortest one: depth first, long pieces first. Every prefix has
        one finite path, so a place from which none goes on is dead for good."""
        n, trie, pieces = len(text), self.trie, self.m["pieces"]
        dead = bytearray(n + 1)
        stack: list[tuple] = []
        i, last, arcs = 0, "", None
        while i < n:
            if arcs is None:
                arcs, node, j = [], trie, i
                while j < n and (node := node.get(text[j])) is not None:
                    j += 1
                    if "" in node:
                        arcs.append((node[""], j))
                if text[i] not in pieces:
                    arcs.append((("", -1, 0.0), i + 1))
            known = self.pairs.get(last)
            if known is None:
                if self.n_pairs > MEMO:
                    self.pairs.clear()
                    self.n_pairs = 0
                known = self.pairs[last] = {}
            while arcs:
                end, j = arcs.pop()
                if dead[j]:
                    continue
                b = end[0]
                if last and b:
                    ok = known.get(b)
                    if ok is None:
                        ok = known[b] = self._merged(last + b) == [last, b]
                        self.n_pairs += 1
                    if not ok:
                        continue
                stack.append((i, last, arcs, end[1]))
                i, last, arcs = j, b, None
                break
            else:
                dead[i] = 1
                i, last, arcs, _ = stack.pop()
        out: list[int] = []
        for at, _, _, id_ in stack:
            if id_ >= 0:
                out.append(id_)
            else:
                out += self._fallback(text[at])
        return out

    def _back(self, text: str, came: list) -> list[int]:
        out: list[int] = []
        n = len(text)
        while n:
            i, id_ = came[n]
            out += [id_] if id_ >= 0 else self._fallback(text[i:n])[::-1]
            n = i
        return out[::-1]

    def _segment(self, text: str) -> bytes:
        """Ids of a segment that isn't remembered, from those of its parts."""
        got = self.older.get(text)
        if got is None:
            touch, parts, ids = self.touch, self.parts, []
            cuts = [0, *[k for k in range(1, len(text)) if text[k - 1 : k + 1] not in touch], len(text)]
            for a, b in pairwise(cuts):
                part = text[a:b]
                found = parts.get(part)
                if found is None:
                    found = self.path(part)
                    if len(part) < 12 and len(parts) < MEMO:
                        parts[part] = found
                ids += found
            got = struct.pack(f"<{len(ids)}i", *ids)
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        found = self.segments.findall(self.normal(text))
        memo = self.memo
        if len(memo) > MEMO:  # the last two generations are remembered
            self.older, self.memo = memo, {}
            memo = self.memo
        out = []
        for s in found:
            ids = memo.get(s)
            if ids is None:
                ids = memo[s] = self._segment(s)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.m["prefix"] and text[:1] == " " else text


def _transducer(model) -> Transducer:
    """Compiled once in each Python worker."""
    return held_model(("pieces", id(model)), lambda: Transducer(model))


def encode(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of df (or those of keep) with ids array<int>, n_bytes long (ids of byte fallback) and round_trip boolean
    (whether decoding gives the text again; it can't where the text has U+2581 or the normaliser changed it).

    A null text has null ids and round_trip, an empty one no ids. Whole texts are encoded. Input columns named ids,
    n_bytes or round_trip are replaced; repeated rows get the same ids each.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "n_bytes", "round_trip")]
    bounded_batches(df.sparkSession)
    model_ = df.sparkSession.sparkContext.broadcast(model)  # one vocabulary
    added = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_bytes", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model_.value)
        by_byte = np.zeros(model_.value["size"], bool)
        by_byte[list(model_.value["bytes"].values())] = True
        for batch in slices(batches, n_kept):
            parts, ends, falls, trips, nulls = [], [0], [], [], []
            for x in batch.column(n_kept).to_pylist():
                if x is None:
                    parts.append(b"")
                    falls.append(None)
                    trips.append(None)
                else:
                    got = t.encode(x)
                    ids = np.frombuffer(got, "<i4")
                    parts.append(got)
                    falls.append(int(by_byte[ids].sum()))
                    trips.append(t.decode(ids.tolist()) == x)
                nulls.append(x is None)
                ends.append(ends[-1] + len(parts[-1]) // 4)
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(nulls, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], ids, pa.array(falls, pa.int64()), pa.array(trips, pa.bool_())], names=[*kept, "ids", "n_bytes", "round_trip"])

    return df.select(*kept, F.col(text).alias("_text_")).mapInArrow(run, schema)


def decode(df: DataFrame, model: dict, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text that ids stand for; null for null. Ids outside the vocabulary are an error."""
    model_ = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _transducer(model_.value)
        for s in batches:
            yield s.map(lambda x: None if x is None else t.decode(x))

    return df.withColumn(to, decoded(F.col(ids)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """Every document's ids, how many there are and stand for single bytes, and whether decoding gives the text again."""
    out = encode(load(spark, sf_dir, "documents"), compile_model(path), keep=["doc_id"])
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "n_bytes", "round_trip")
