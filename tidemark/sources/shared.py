"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where nothing is set and all runs in one JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tidemark-shared"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    store, at = file_system(spark, path)
    store.deleteOnExit(at)
    return path


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """A file with this content at path, all of it or none: written beside it and renamed. False, and nothing done, if there is one already.
    Two that publish at once can't both win where the store renames in one step (HDFS does)."""
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"  # hidden from readers of the folder
    store, at = file_system(spark, beside)
    if store.exists(file_system(spark, path)[1]):
        return False
    out = store.create(at, True)
    out.write(bytearray(content.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    without = spark.sparkContext._gateway.new_array(rename, 1)
    without[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at, file_system(spark, path)[1], without)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        store.delete(at, False)
        return False
    return True


def content(spark: SparkSession, path: str) -> str:
    """Of a small file."""
    store, at = file_system(spark, path)
    found = store.open(at)
    try:
        return bytes(found.readAllBytes()).decode()
    finally:
        found.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Of the files and folders in a folder; none if there is no such folder."""
    store, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that its lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
