"""What streaming queries report of their batches, kept and measured."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.metrics import latency

PROGRESS = "query string, batch long, rows long, trigger_ms double, batch_ms double, state_ms double, state_rows long, watermark string"


class Progress(StreamingQueryListener):
    """Keeps a row a batch of each named query, the last 10,000 of them; `with Progress(spark) as p:` listens meanwhile."""

    def __init__(self, spark: SparkSession, most: int = 10_000):
        self._session, self._most, self._rows, self._lock = spark, most, [], threading.Lock()

    def __enter__(self) -> Progress:
        self._session.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._session.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        self._session.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.allUpdatesTimeMs + s.allRemovalsTimeMs + s.commitTimeMs for s in p.stateOperators)
        row = (p.name, p.batchId, p.numInputRows, float(p.durationMs.get("triggerExecution", 0)), float(p.durationMs.get("addBatch", 0)), float(state), sum(s.numRowsTotal for s in p.stateOperators), p.eventTime.get("watermark"))
        with self._lock:
            self._rows = [*self._rows[1 - self._most :], row]

    def batches(self) -> DataFrame:
        """PROGRESS rows so far; state_ms is summed over the tasks."""
        with self._lock:
            return self._session.createDataFrame(list(self._rows), PROGRESS)

    def latencies(self) -> DataFrame:
        """Per query: n, p50, p90 and mean of what its batches took, from trigger to commit."""
        return latency(self.batches(), ["query"], "trigger_ms")
