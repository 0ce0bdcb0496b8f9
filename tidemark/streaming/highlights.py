"""Highlights from a stream of scored windows, with state for each (match, question).

Windows wait in state until the watermark passes the short cell of time that they end in; a timer then takes a cell's windows in the
order of time, whatever order they came in, so a batch may bring a match's whole past and memory holds a cell. A highlight closes
on the first window, positive or not, that starts more than gap after its end or would make it longer than max_len, or by a timer
once no window that could still join it can come. Starts and ends are those of operators.triggers.merge_capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Rows out: a highlight when it closes, or (kind trace) what a window scored, at its end.
HIGHLIGHT = "kind string, match string, question string, start double, end double, peak_prob double, peak_wid string, first_latency_ms double"
_OPEN = "start double, end double, peak_prob double, peak_wid string, first_latency_ms double"
#: Windows of a key that are gathered before they go into state.
AT_ONCE = 1000
_WINDOWS = "windows array<struct<start:double,end:double,wid:string,prob:double,latency_ms:double>>"


class Scored(NamedTuple):
    start: float
    end: float
    wid: str
    prob: float | None
    latency_ms: float | None


class Highlight(NamedTuple):
    start: float
    end: float
    peak_prob: float
    peak_wid: str
    first_latency_ms: float | None

    def takes(self, w: Scored, gap: float, max_len: float) -> bool:
        return w.start <= self.end + gap and w.end <= self.start + max_len

    def with_(self, w: Scored) -> Highlight:
        """With a positive window more; peaks are rounded to 4 places when they are taken, and compared with the rounded one."""
        higher = w.prob > self.peak_prob
        return Highlight(self.start, w.end, round(w.prob, 4) if higher else self.peak_prob, w.wid if higher else self.peak_wid, self.first_latency_ms)


class Highlighter(StatefulProcessor):
    def __init__(self, thresholds: dict[str, float], gap: float, max_len: float, length: float, cell: float, traced: str | None):
        self.thresholds, self.gap, self.max_len, self.length, self.cell, self.traced = thresholds, gap, max_len, length, cell, traced

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "until long", _WINDOWS)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timers, some = set(), {}
        for n, r in enumerate(rows, 1):
            some.setdefault(self._until(r["end"]), []).append((r["start"], r["end"], r["wid"], r["prob"], r["latency_ms"]))
            if self._positive(key[1], r["prob"]):  # set here, as a timer that is set by another fires a batch later
                timers.add(self._until(self._due(r["end"])))
            if n % AT_ONCE == 0:
                timers |= self._wait(some)
        for at in timers | self._wait(some):
            self.handle.registerTimer(at)
        return iter(())

    def _wait(self, some: dict[int, list]) -> set[int]:
        """Puts windows into state, by the time at which they are taken."""
        times = set(some)
        for at in times:
            before = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
            self.waiting.updateValue((at,), ([*(tuple(x) for x in (before[0] if before else [])), *some.pop(at)],))
        return times

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        match, question = key
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = Highlight(*self.open.get()) if self.open.exists() else None
        was, out = held, []
        if self.waiting.containsKey((now,)):
            for w in sorted((Scored(*x) for x in self.waiting.getValue((now,))[0]), key=lambda w: (w.end, w.start, w.wid)):
                if held and not held.takes(w, self.gap, self.max_len):
                    out.append(held)
                    held = None
                if self._positive(question, w.prob):
                    held = held.with_(w) if held else Highlight(w.start, w.end, round(w.prob, 4), w.wid, w.latency_ms)
                if question == self.traced:
                    yield Row(kind="trace", match=match, question=question, start=w.start, end=w.end, peak_prob=w.prob, peak_wid=w.wid, first_latency_ms=w.latency_ms)
            self.waiting.removeKey((now,))
        if held and self._due(held.end) * 1000 <= now:
            out.append(held)
            held = None
        if held:
            if held != was:
                self.open.update(tuple(held))
        elif was:
            self.open.clear()
        for h in out:
            yield Row(kind="highlight", match=match, question=question, **h._asdict())

    def _positive(self, question: str, prob: float | None) -> bool:
        return prob is not None and prob >= self.thresholds.get(question, float("inf"))

    def _until(self, t: float) -> int:
        """The end, in ms, of the cell that a time falls into."""
        return round(math.ceil(t / self.cell) * self.cell * 1000)

    def _due(self, end: float) -> float:
        """When a highlight that ends there closes: a window that joins starts by end + gap, and so ends length later at most."""
        return end + self.gap + self.length

    def close(self) -> None:
        pass


def long_scores(scored: DataFrame, questions: list[str]) -> DataFrame:
    """(match, question, wid, start, end, prob, at, latency_ms) of windows with one column a question."""
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).cast("double").alias("prob")) for q in questions]))
    return scored.select(F.col("match").cast("string").alias("match"), "wid", "start", "end", "at", "latency_ms", each.alias("x")).select("match", "x.question", "wid", "start", "end", "x.prob", "at", "latency_ms")


def highlights(scores: DataFrame, thresholds: dict[str, float], gap: float = 30.0, max_len: float = 120.0, length: float = 20.0, late: str = "10 minutes", traced: str | None = None, cell: float = 5.0) -> DataFrame:
    """HIGHLIGHT rows of a streaming long_scores frame whose `at` (a timestamp) is the window's end; length is that of the longest window.

    A row goes out once, when its highlight is closed. Windows are taken `cell` seconds at a time, so a longer cell is less work and a
    later row. Windows older than the watermark, `late` behind the newest, are dropped. A null score is not positive. traced is a
    question whose every score goes out too. The session's state store must be RocksDB (see replay.rocks).
    """
    return scores.withWatermark("at", late).groupBy("match", "question").transformWithState(Highlighter(thresholds, gap, max_len, length, cell, traced), HIGHLIGHT, "append", "eventTime")


def intensity_trace(scored: DataFrame, score: str = "intensity") -> DataFrame:
    """(match, t, score) as windows come."""
    return scored.select(F.col("match").cast("string").alias("match"), F.col("end").alias("t"), F.col(score).cast("double").alias("score"))
