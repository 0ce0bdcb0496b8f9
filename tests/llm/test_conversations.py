import hashlib
import heapq
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import conversations as c

MOVES = {0: "su", 1: "u", 2: "a", 3: "u"}
TO = {"s": 1, "u": 2, "a": 3}
SCHEMA = "conv_id long, turn long, role string, text string, cost string, edit string"


def brute(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Dijkstra over (row, state) with (cost, edits so far); rows are (initial, fault)."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        for r in MOVES[q].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, TO[r]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial in MOVES[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, TO[initial]))
                for r in MOVES[q].replace("s", ""):
                    if r != initial:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, TO[r]))


@settings(max_examples=400)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(c.FAULTS[:4])), max_size=14))
def test_repairs_are_cheapest_and_least(rows):
    symbols = bytes(4 * c.FAULTS.index(fault) + "suax".index(initial) for initial, fault in rows)
    assert c.Repairer().repair(symbols) == brute(rows)


def test_states_are_few_and_long_conversations_scan():
    r = c.Repairer()
    cost, audit = r.repair(bytes([1, 2] * 200_000 + [0, 7, 13, 2] * 5_000))
    assert len(r.vectors) < 200 and audit.startswith("KK") and cost > 0


def reference(rows: list[tuple]) -> dict:
    """The whole contract in plain Python."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        found[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, some in found.items():
        some.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in some:
            said = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = brute([(x[1][:1] or "-", fault) for x, fault in zip(some, faults, strict=True)])
        left, q, lines = iter(some), 0, []
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e == "D":
                continue
            if e != "K":
                role = {"u": "user", "a": "assistant"}[MOVES[q][-1]]
            q = TO[role[0]]
            lines.append(f"{role}:{text}")
        turns = [x[0] for x in some if x[0] is not None]
        initials = [x[1][:1] for x in some]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in c.FAULTS[1:4]), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ODD = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Hi"), (1, 1, "assistant", "Hi"), (1, None, "system", "Be kind!"), (1, 9, "tool", "42."),
    (2, 0, None, None), (2, 1, "", "no role."), (2, 2, "user", "  \x0b\t\r\n"), (2, 3, "user", "a nbsp\xa0"), (2, 4, "user", "ends. \n"),
    (None, 0, "user", "Whose?"), (None, None, "assistant", "Nobody's."), (3, -5, "umpire", "x?"), (3, 7, "Assistant", "y!"),
    *[(4, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of many. " + "word " * 40) for t in range(400)],
    (5, 0, "user", "long " * 400_000 + "."), (5, 1, "assistant", "Ünïcødé 🦄?"),
]


def test_rows_against_brute_force(spark):
    rows = [(*x, "cost", "edit") for x in ODD]
    got = {x[0]: tuple(x)[1:] for x in c.digests(c.damaged(spark.createDataFrame(rows, SCHEMA).repartition(7))).collect()}
    assert got == reference(ODD)


def test_conversations_without_rows(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = c.digests(c.damaged(spark.createDataFrame([(conv, 0, "user", "gone", "", "")], SCHEMA))).collect()
    assert [tuple(x) for x in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.digests(c.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_repaired_rows_are_legal(spark):
    rows = c.damaged(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    out = c.repaired(rows).orderBy("conv_id", "pos").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("i"))
    assert out.where(~F.col("i").rlike("^(s?(ua)+)?$")).count() == 0 and out.count() > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = {x[0]: x[1:] for x in con.execute(c.ORACLE["op13_conversation_repair"]).fetchall()}
    assert {x[0]: tuple(x)[1:] for x in c.op13_conversation_repair(spark, f"/root/testdata/{sf}").collect()} == want
