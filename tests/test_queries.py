"""Every query of the engine that has a SQL twin gives DuckDB's rows; the stream gives the batch's."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from keystrata.operators import resolve
from keystrata.plans import catalog
from keystrata.sources import oplog
from keystrata.streaming import upsert

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_filters_have_no_false_negatives(spark):
    found = catalog.bloom_candidates(spark, DATA).collect()
    keys = {r["segment"]: r["n"] for r in catalog.sst_key_range(spark, DATA).collect()}
    assert {r["segment"]: r["held"] for r in found} == keys


def test_filters_are_probed_with_all_customers(spark, tmp_path):
    rows = [(i, 300 + i % 400) for i in range(1500)]
    events = spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.range(2000).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    found = {r["segment"]: r for r in catalog.bloom_candidates(spark, str(tmp_path)).collect()}
    assert {s: r["held"] for s, r in found.items()} == {0: 400, 1: 400}


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    log = [(f"k{i % 7}", f"v{i}", 0, i % 5 == 0, i) for i in range(60)]
    schema = "key string, value string, expiry_ns long, is_deleted boolean, seq long"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for at in range(0, 60, 20):
        spark.createDataFrame(log[at : at + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # a new query each time: it goes on from its checkpoint
        upsert.run_upsert(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), out, checkpoint)
    got = sorted(map(tuple, upsert.read_upsert(spark, out).collect()))
    want = sorted(map(tuple, resolve.latest(spark.createDataFrame(log, schema)).select(*upsert.COLUMNS).collect()))
    assert got == want


def test_unix_nanos_ignores_the_session_zone(spark):
    value = "SELECT TIMESTAMP_NTZ '2024-03-31 02:30:15.123456' AS ts"
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = spark.sql(value).select(oplog.unix_nanos(F.col("ts"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == 1711852215123456000
