"""A table as a stream in the order of its time, at a speed: a streaming data source that hands out time slots when they are due."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.shared import new_path

_SLOTS, _STATE = "slots", "began.json"


def lay_out(rows: DataFrame, label: str, t: str = "end", step: float = 5.0) -> str:
    """Writes rows by slots of `step` seconds of column t, into the shared folder; the path is what stream() takes. A null time goes
    with the first slot. Every slot is written and read by as many tasks as have rows of it."""
    top = new_path(rows.sparkSession, label)
    slot = F.floor(F.coalesce(F.col(t), F.lit(0.0)) / step).cast("long")
    rows.withColumn("_slot", F.greatest(slot, F.lit(0))).write.partitionBy("_slot").parquet(f"{top}/{_SLOTS}")
    return top


class _Files(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _store(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path.replace("s3a://", "s3://") if "://" in path else f"file://{path}")


class _Reader(DataSourceStreamReader):
    """Offsets name the first slot that isn't handed out yet. When the replay began is kept beside the table, so a query that goes on
    from its checkpoint goes on on the same clock."""

    def __init__(self, options: dict, names: list[str]):
        self.top, self.speed, self.step, self.names = options["path"], float(options.get("speed", 0)), float(options.get("step", 5)), names
        self.files: dict[int, list[str]] = {}

    def _slots(self) -> dict[int, list[str]]:
        if not self.files:
            store, at = _store(f"{self.top}/{_SLOTS}")
            for f in store.get_file_info(FileSelector(at, recursive=True, allow_not_found=True)):
                if f.type == FileType.File and f.path.endswith(".parquet"):
                    self.files.setdefault(int(f.path.split("_slot=")[1].split("/")[0]), []).append(f.path)
        return self.files

    def _began(self) -> float:
        store, at = _store(f"{self.top}/{_STATE}")
        if store.get_file_info(at).type == FileType.NotFound:
            with store.open_output_stream(at) as out:
                out.write(json.dumps({"began": time.time()}).encode())
        with store.open_input_stream(at) as found:
            return json.loads(found.read())["began"]

    def initialOffset(self) -> dict:
        return {"slot": min(self._slots(), default=0)}

    def latestOffset(self) -> dict:
        slots = self._slots()
        first, end = min(slots, default=0), max(slots, default=-1) + 1
        if self.speed <= 0:
            return {"slot": max(first, end)}
        due = int((time.time() - self._began()) * self.speed / self.step) + 1  # the first slot is due at once
        return {"slot": max(first, min(end, first + due))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Files(p) for slot, paths in sorted(self._slots().items()) if start["slot"] <= slot < end["slot"] for p in sorted(paths)]

    def read(self, partition: _Files) -> Iterator:
        store = _store(self.top)[0]
        with store.open_input_file(partition.path) as f:
            yield from pq.ParquetFile(f).iter_batches(columns=self.names)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Paced(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options), schema.names)


def stream(spark: SparkSession, top: str, like: DataFrame, speed: float = 0.0, step: float = 5.0) -> DataFrame:
    """The rows that lay_out wrote, with the columns of `like`, as a stream: `speed` seconds of the table for each second of the clock, 0
    for all at once. step is that of lay_out."""
    spark.dataSource.register(Paced)
    return spark.readStream.format("paced").schema(like.schema).option("path", top).option("speed", str(speed)).option("step", str(step)).load()


def ended(top: str, progress) -> bool:
    """Whether a query's last progress says that every slot was handed out and its batch is done."""
    last = max(_Reader({"path": top}, [])._slots(), default=-1) + 1
    if not last:
        return True
    if progress is None or not progress.sources or not progress.sources[0].endOffset:
        return False
    return int(re.search(r"\d+", progress.sources[0].endOffset)[0]) >= last  # {"slot": n}, or as Python prints it
