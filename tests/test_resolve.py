"""Reduction, lookups and tiers against a dictionary, on fixed cases and random op-logs."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import resolve

SCHEMA = "key string, value string, expiry_ns long, is_deleted boolean, seq long"


def model(rows, now_ns):
    state = {}
    for row in sorted(rows, key=lambda r: r[4]):
        state[row[0]] = row
    return {k: r[1] for k, r in state.items() if not r[3] and not (r[2] > 0 and now_ns > r[2])}


def live(spark, rows, now_ns):
    return {r["key"]: r["value"] for r in resolve.live(spark.createDataFrame(rows, SCHEMA), F.lit(now_ns)).collect()}


def random_log(seed, n=300):
    pick = random.Random(seed)
    return [(f"k{pick.randrange(25)}", "" if (d := pick.random() < 0.2) else f"v{i}", pick.choice([0, 0, 50, 100, 150]), d, i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_live_matches_a_dictionary(spark, seed):
    rows = random_log(seed)
    assert live(spark, rows, 100) == model(rows, 100)


def test_expired_or_deleted_newest_hides_older(spark):
    rows = [("a", "old", 0, False, 1), ("a", "new", 5, False, 2), ("b", "old", 0, False, 3), ("b", "", 0, True, 4), ("c", "", 0, True, 5), ("c", "again", 0, False, 6)]
    assert live(spark, rows, 6) == {"c": "again"}


def test_live_at_the_instant_of_expiry(spark):
    assert live(spark, [("a", "x", 10, False, 1)], 10) == {"a": "x"}
    assert live(spark, [("a", "x", 10, False, 1)], 11) == {}


def test_odd_keys_and_values(spark):
    rows = [("", "empty", 0, False, 1), ("é𝄞", 'q"\n\\', 0, False, 2), ("k", "", 0, False, 3)]
    assert live(spark, rows, 0) == {"": "empty", "é𝄞": 'q"\n\\', "k": ""}


def test_negative_ttl_never_expires(spark):
    got = spark.createDataFrame([(1, 10), (2, 0), (3, -4)], "i int, ttl int").select("i", resolve.expiry(F.col("ttl"), F.lit(7).cast("long")).alias("e")).collect()
    assert {r["i"]: r["e"] for r in got} == {1: 7 + 10 * 10**9, 2: 0, 3: 0}


def test_lookup_outcomes(spark):
    log = spark.createDataFrame([("a", "x", 0, False, 1), ("b", "", 0, True, 2), ("c", "y", 3, False, 3)], SCHEMA)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "key string")
    got = sorted((r["key"], r["outcome"], r["value"]) for r in resolve.lookup(keys, log, F.lit(9)).collect())
    assert got == [("a", "live", "x"), ("a", "live", "x"), ("b", "deleted", None), ("c", "expired", None), ("d", "missing", None)]


def test_first_tier_equals_global_newest(spark):
    rows = random_log(9)
    tiers = [spark.createDataFrame([r for r in rows if r[4] in part], SCHEMA) for part in (range(200, 300), range(100, 200), range(100))]
    by_tier = {r["key"]: r["seq"] for r in resolve.first_tier(tiers).collect()}
    assert by_tier == {r["key"]: r["seq"] for r in resolve.latest(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_empty_log(spark):
    assert live(spark, [], 0) == {}


def test_key_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(random_log(1), SCHEMA).write.parquet(str(tmp_path / "log"))
    found = resolve.latest(spark.read.parquet(str(tmp_path / "log"))).where(F.col("key") == "k3")
    assert "EqualTo(key,k3)" in found._jdf.queryExecution().toString()
