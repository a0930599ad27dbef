"""Op-logs made from tables, and requests in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000

PUT = "key string, value string, ttl int"
BATCH = f"items array<struct<{PUT.replace(' ', ':').replace(',:', ',')}>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unix_nanos(ts: Column) -> Column:
    """Nanoseconds since 1970 of a time without a zone, whatever the session's zone."""
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20, 6)") * F.lit(1_000_000).cast("decimal(8, 0)")).cast("long") * 1_000


def event_log(events: DataFrame, *more: str) -> DataFrame:
    """key, value, expiry_ns, is_deleted, seq and ``more`` columns: errors delete, sign-ups live for a day, all else is put
    for good."""
    deleted = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"),
        F.when(deleted, "").otherwise(F.col("props")).alias("value"),
        F.when(F.col("event_type") == "signup", unix_nanos(F.col("ts")) + F.lit(DAY_NS)).otherwise(F.lit(0).cast("long")).alias("expiry_ns"),
        deleted.alias("is_deleted"),
        F.col("event_id").alias("seq"),
        *more,
    )


def last_instant(events: DataFrame) -> Column:
    """The time of the last event, as a scalar of the query."""
    return events.agg(unix_nanos(F.max("ts"))).scalar()


def order_log(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("cust:"), F.col("o_custkey")).alias("key"),
        F.col("o_orderpriority").alias("value"),
        F.lit(0).cast("long").alias("expiry_ns"),
        (F.col("o_orderstatus") == "F").alias("is_deleted"),
        F.col("o_orderkey").alias("seq"),
    )


def parse_puts(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds the status of put requests, and key, value, ttl of the good ones; missing fields are empty or 0."""
    parsed = requests.withColumn("_put", F.from_json(F.col(body), PUT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("_put").isNotNull() & F.col("_put._corrupt").isNull()
    return parsed.select(
        *requests.columns,
        F.when(good, 201).otherwise(400).alias("status"),
        F.when(good, F.coalesce("_put.key", F.lit(""))).alias("key"),
        F.when(good, F.coalesce("_put.value", F.lit(""))).alias("value"),
        F.when(good, F.coalesce("_put.ttl", F.lit(0))).alias("ttl"),
    )


def key_status(key: Column) -> Column:
    """Lookups and deletes need a key."""
    return F.when(F.coalesce(key, F.lit("")) == "", 400).otherwise(200)


def unpack_batches(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row an item of batch requests, with its place in the batch."""
    items = F.from_json(F.col(body), BATCH)["items"]
    rest = [c for c in requests.columns if c != body]
    return requests.select(*rest, F.posexplode(items).alias("pos", "item")).select(*rest, F.col("pos").cast("long").alias("pos"), "item.key", "item.value", F.coalesce("item.ttl", F.lit(0)).alias("ttl"))
