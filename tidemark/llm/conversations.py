"""Conversation structure repair by lazy weighted determinisation.

A repaired conversation's role initials match `(s?(ua)+)?`, a small automaton; edits of its rows are weighted arcs. What the rest
of a conversation costs from each state is a vector; less its least entry, it is one of finitely many. Those vectors are the
states of a deterministic automaton, built as they are met and kept in a table, so a conversation is scanned from its end by table
look-ups alone. Back over the scan, in the order of the text, arcs that are tight give the edits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, load

#: Costs of edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INITIALS = "sua"
START, ASSISTANT = 0, 3
#: Of each state (start, after s, after u, after a): where a role's initial leads. Start and "after a" may end.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated", "dropped")
_BLANK, _DUPLICATE, _TRUNCATED, _DROPPED = 1, 2, 3, 4
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au, as places in INITIALS
AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _insertion(q: int) -> tuple[str, int]:
    """The one role that may be inserted at a state, and where it leads."""
    return next((r, to) for r, to in MOVES[q].items() if r != "s")


def _closed(costs: list[int]) -> list[int]:
    """Costs to go, with insertions before the next row."""
    for _ in MOVES:
        costs = [min(c, INSERT + costs[_insertion(q)[1]]) for q, c in enumerate(costs)]
    return costs


class Repairer:
    """The lazily built automaton. A symbol is 4 * fault + place of the initial in INITIALS (3: another), as _symbol() makes it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self._table: dict[tuple[int, int], tuple[int, int]] = {}
        self._traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, _ = self._state(_closed([0, 10**6, 10**6, 0]))

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self._ids:
            self._ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self._ids[vector], least

    def _arcs(self, symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
        """(initial of the edit, its cost, state it leads to) of a row at a state, by initial."""
        fault, place = divmod(symbol, 4)
        yield "D", DELETE, q
        if fault not in (_BLANK, _DUPLICATE):
            extra = TRUNCATED if fault == _TRUNCATED else 0
            if place < 3 and INITIALS[place] in MOVES[q]:
                yield "K", extra, MOVES[q][INITIALS[place]]
            yield "R", REROLE + extra, _insertion(q)[1]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state of costs to go before a row, from that after it, and what to add to its vector."""
        found = self._table.get((state, symbol))
        if found is None:
            after = self.vectors[state]
            found = self._table[state, symbol] = self._state(_closed([min(cost + after[to] for _, cost, to in self._arcs(symbol, q)) for q in range(len(MOVES))]))
        return found

    def _edits(self, state: int, symbol: int, q: int) -> tuple[str, int]:
        """The ASCII-least tight edits up to and with a row, from a state, and the state after them."""
        found = self._traces.get((state, symbol, q))
        if found is None:
            key, out, after = (state, symbol, q), "", self.vectors[state]
            before, least = self.step(state, symbol)
            here = [c + least for c in self.vectors[before]]
            while True:
                tight = [(e, to) for e, cost, to in self._arcs(symbol, q) if cost + after[to] == here[q]]
                inserted = _insertion(q)[1]
                if INSERT + here[inserted] == here[q]:
                    tight.append(("I", inserted))
                edit, q = min(tight)
                out += edit
                if edit != "I":
                    break
            found = self._traces[key] = (out, q)
        return found

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost of a conversation, and the ASCII-least initials of edits at that cost."""
        state, cost, states, step = self.end, 0, array("H", bytes(2 * len(symbols))), self.step
        for i in range(len(symbols) - 1, -1, -1):
            states[i] = state
            state, least = step(state, symbols[i])
            cost += least
        cost += self.vectors[state][START]
        q, out, edits = START, [], self._edits
        for i, symbol in enumerate(symbols):
            some, q = edits(states[i], symbol, q)
            out.append(some)
        while self.vectors[self.end][q]:
            out.append("I")
            q = _insertion(q)[1]
        return cost, "".join(out)


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after damage by crc32 of `conv_id:turn` modulo 20, nulls as one space: 0 drops the row (it is
    kept with dropped, so that its conversation isn't lost), 1 empties the text, 2 removes its .!?, 3 repeats it, 4 sets role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), kind.alias("_kind"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_time")
    return rows.select("conv_id", "turn", "role", "text", (F.col("_kind") == 0).alias("dropped"), times).drop("_time")


def _symbol(fault: Column, role: Column) -> Column:
    place = F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)
    return (4 * fault + place).cast("byte")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def audits(rows: DataFrame) -> DataFrame:
    """conv_id and AUDIT of each conversation of rows (conv_id, turn, role, text, dropped).

    Rows go by turn, nulls first, and within a turn by role and the SHA-256 of their text, so repeated rows are adjacent. A role is
    known by its initial; an empty role, or one of another initial, can't be kept. Null roles and texts are not expected: damaged()
    turns them into a space. All rows with a null conv_id are one conversation. Texts don't move: a row is its digest here, and a
    conversation is held as three bytes a row, less than its audit's own row takes.
    """
    turn = F.asc_nulls_first("turn")
    narrow = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("_d"), "dropped", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("_said"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z").alias("_ended"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "_d").orderBy(turn))
    fault = F.when(F.col("dropped"), _DROPPED).when(~F.col("_said"), _BLANK).when(F.col("_n") > 1, _DUPLICATE).when(~F.col("_ended"), _TRUNCATED).otherwise(0)
    found = narrow.repartition("conv_id").withColumn("_n", seen).withColumn("_symbol", _symbol(fault, F.col("role")))
    found = found.sortWithinPartitions("conv_id", turn, "role", "_d", "_n").select("conv_id", "turn", "_symbol")

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, out = Repairer(), []
        for batch in _conversations(batches):
            conv, turns, symbols = batch
            faults = [0] * len(FAULTS)
            for s in symbols:
                faults[s >> 2] += 1
            real = bytes(s for s in symbols if s >> 2 != _DROPPED)
            illegal = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(real, real[1:], strict=False))
            cost, audit = repairer.repair(real)
            out.append((conv, turns, faults[_BLANK], faults[_DUPLICATE], faults[_TRUNCATED], illegal, cost, audit))
            if len(out) >= 2000 or len(audit) > 1 << 20:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    kind = found.schema["conv_id"].dataType.simpleString()
    schema = _arrow_schema(f"conv_id {kind}, {AUDIT}", found.sparkSession)
    return found.mapInArrow(audited, f"conv_id {kind}, {AUDIT}")


def _arrow_schema(ddl: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, gaps, symbols) of each run of equal conv_id; batches may cut a conversation anywhere."""
    begun, conv, symbols, first, last, distinct = False, None, bytearray(), None, None, 0
    for batch in batches:
        for c, turn, symbol in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not begun or c != conv:
                if begun:
                    yield conv, last - first + 1 - distinct if distinct else 0, bytes(symbols)
                begun, conv, symbols, first, last, distinct = True, c, bytearray(), None, None, 0
            symbols.append(symbol)
            if turn is not None and symbol >> 2 != _DROPPED and turn != last:
                first, last, distinct = turn if first is None else first, turn, distinct + 1
    if begun:
        yield conv, last - first + 1 - distinct if distinct else 0, bytes(symbols)


def _edited(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Of each conversation a row with its AUDIT and no edit, then its repaired rows in order; a partition holds whole conversations.

    Audits come first in the one shuffle that texts take, and texts stream past them: nothing but an audit is held.
    """
    names = [f.split()[0] for f in AUDIT.split(", ")]
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("_k"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), _digest(F.col("text")).alias("_d"))
    both = audit.withColumn("_k", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "_k", F.asc_nulls_first("turn"), "role", "_d").select("conv_id", *names, "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, {AUDIT}, pos long, edit string, turn long, role binary, text binary"
    schema = _arrow_schema(ddl, rows.sparkSession)
    no_audit = (None,) * len(names)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, pos, q = None, "", 0, 0, START

        def insertions(out: list) -> None:
            nonlocal at, pos, q
            while at < len(audit) and audit[at] == "I":
                role, q = _insertion(q)
                out.append((conv, *no_audit, pos, "I", None, ROLES[role].encode(), b""))
                at, pos = at + 1, pos + 1

        for batch in batches:
            out: list = []
            for c, *stats, turn, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if stats[-1] is not None:
                    insertions(out)
                    conv, audit, at, pos, q = c, stats[-1], 0, 0, START
                    out.append((c, *stats, None, None, None, None, None))
                    continue
                insertions(out)
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    initial, q = _insertion(q)
                    role = ROLES[initial].encode()
                else:
                    q = MOVES[q][role[:1].decode()]
                out.append((c, *no_audit, pos, edit, turn, role, text))
                pos += 1
            yield _batch(out, schema)
        out = []
        insertions(out)
        yield _batch(out, schema)

    bounded_batches(rows.sparkSession)
    return both.mapInArrow(edited, ddl)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, turn, role, text) of the repaired conversations: K kept, R another role, I inserted with an empty text. Rows as
    audits() takes them; what is deleted has no row, and a conversation without rows has none."""
    out = _edited(rows, audits(rows)).where("edit is not null")
    return out.select("conv_id", "pos", "edit", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, AUDIT and repaired_sha256 (of `role:text` of the repaired rows, joined by newlines) of each conversation."""
    edited = _edited(rows, audits(rows)).select("conv_id", *[f.split()[0] for f in AUDIT.split(", ")], "role", "text")
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {AUDIT}, repaired_sha256 string"
    schema = _arrow_schema(ddl, rows.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, n = None, hashlib.sha256(), 0
        for batch in batches:
            out: list = []
            for *stats, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if stats[-1] is not None:
                    if head is not None:
                        out.append((*head, sha.hexdigest()))
                    head, sha, n = stats, hashlib.sha256(), 0
                    continue
                sha.update((b"\n" if n else b"") + role + b":" + text)
                n += 1
            yield _batch(out, schema)
        yield _batch([(*head, sha.hexdigest())] if head is not None else [], schema)

    return edited.mapInArrow(hashed, ddl)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage of all conversations, and the cheapest repair of each."""
    return digests(damaged(load(spark, sf_dir, "conversations")))


ORACLE = {
    "op13_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS d FROM k, crc),
g AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS time FROM h),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS n FROM g),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN n > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i NOT IN ('su', 'ua', 'au') AS bad FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
mv(q, i, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ip(q, z, c, e, w) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'u'), (1, 2, 3, 'I', 'u'), (3, 2, 3, 'I', 'u'), (2, 3, 3, 'I', 'a'), (0, 3, 6, 'II', 'ua'), (1, 3, 6, 'II', 'ua')),
arc AS (SELECT conv_id, p, q, q AS z, 4 AS c, 'D' AS e, '' AS w FROM f, range(4) r(q)
  UNION ALL SELECT conv_id, p, q, z, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', 'k' FROM f JOIN mv USING (i) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, p, q, z, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', mv.i FROM f, mv WHERE fault NOT IN ('blank', 'duplicate') AND mv.i <> 's'),
bo AS (SELECT a.conv_id, a.p, ip.q, a.z, ip.c + a.c AS c, ip.e || a.e AS e FROM arc a JOIN ip ON ip.z = a.q),
dp AS (SELECT conv_id, 0::BIGINT AS p, 0 AS q, {'c': 0::BIGINT, 'a': ''} AS v FROM ids
  UNION ALL SELECT b.conv_id, b.p, b.z, min({'c': dp.v.c + b.c, 'a': dp.v.a || b.e}) FROM dp JOIN bo b ON b.conv_id IS NOT DISTINCT FROM dp.conv_id AND b.p = dp.p + 1 AND b.q = dp.q GROUP BY b.conv_id, b.p, b.z),
fin AS (SELECT dp.conv_id, min({'c': dp.v.c + ip.c, 'a': dp.v.a || ip.e}) AS v FROM dp LEFT JOIN (SELECT conv_id, max(p) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN ip ON ip.q = dp.q AND ip.z IN (0, 3) WHERE dp.p = coalesce(m.n, 0) GROUP BY dp.conv_id),
ed AS (SELECT conv_id, v.c AS cost, v.a AS audit, unnest(range(1, len(v.a) + 1)) AS j FROM fin),
e1 AS (SELECT conv_id, j, audit[j] AS e, count(*) FILTER (audit[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS p, count(*) FILTER (audit[j] <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS s FROM ed),
e2 AS (SELECT e1.conv_id, j, e, s, role, text, max(CASE WHEN s = 1 AND e = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e1.conv_id) AS sys FROM e1 LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e1.conv_id AND f.p = e1.p AND e <> 'I' WHERE e <> 'D'),
rep AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (s - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM e2 GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, fin.v.c AS cost, fin.v.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN fin ON fin.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM ids.conv_id"""
}
