"""Every query against its SQL at the smallest scale."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return found


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    assert rows
    if name in registry.ORACLE:
        found = con.execute(registry.ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == cols
        assert rows == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_between_reaches_the_last_turn(spark, tmp_path):
    from pyspark.sql import functions as F

    c = spark.read.parquet(f"{SF}/conversations.parquet")
    one = c.where(F.col("conv_id") == c.agg(F.min("conv_id")).first()[0]).limit(1)
    text = F.lit(" ".join(f"w{i}" for i in range(40)))
    rows = one.withColumn("turn", F.lit(9).cast(c.schema["turn"].dataType)).withColumn("text", text)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["id"]: x["text"] for x in entry.queries()["text_between"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(10)) and got[9].startswith("w13 ") and got[8] == ""


@pytest.mark.parametrize("name", ["ignore_overlay", "window_labels", "class_balance", "project_ternary", "window_coverage", "teacher_scores"])
def test_windows_are_never_sent_whole(spark, name):
    """Spark takes a side that was exploded for as many rows as before, and would broadcast the windows of all streams."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
