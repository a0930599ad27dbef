"""Filters of segments against plain sets of bits."""

from collections import defaultdict

from pyspark.sql import functions as F

from keystrata.functions.hashing import FilterSize, filter_positions
from keystrata.operators import membership
from keystrata.plans import catalog

ROWS, KEYS = "segment long, key string", "key string"


def plain(spark, rows, keys, size):
    """Candidates and held keys of each segment by the bits of ``filter_positions``, pair by pair."""
    rows, keys = {r for r in rows if None not in r}, {k for (k,) in keys if k is not None}
    pairs = spark.createDataFrame(sorted(rows | {(s, k) for s, _ in rows for k in keys}), ROWS)
    places = {(r["segment"], r["key"]): set(r["p"]) for r in pairs.select("segment", "key", filter_positions(F.col("segment"), F.col("key"), size).alias("p")).collect()}
    bits = defaultdict(set)
    for s, k in rows:
        bits[s] |= places[s, k]
    found = {s: [k for k in keys if places[s, k] <= bits[s]] for s in bits}
    return {s: (len(ks), sum((s, k) in rows for k in ks)) for s, ks in found.items() if ks}


def test_candidates_equal_those_of_all_pairs(spark):
    size = FilterSize.of(300, 0.02)
    rows = [(s, f"k{i * 7 % 5000}") for s in range(-3, 90) for i in range(s % 4, 60 - s % 50)]
    rows += [(1, "ключ"), (1, "ключ"), (2, ""), (200, None), (None, "k7"), (300, "far from all keys")]
    keys = [(f"k{i}",) for i in range(700)] + [("ключ",), ("ключи",), ("",), (None,), ("k7",), ("a much longer key than the others",)]
    got = membership.candidates(spark.createDataFrame(rows, ROWS), spark.createDataFrame(keys, KEYS), size).collect()
    assert len(got) == len({r["segment"] for r in got})
    want = plain(spark, rows, keys, size)
    assert {r["segment"]: (r["candidates"], r["held"]) for r in got} == want
    assert sum(n for n, _ in want.values()) > sum(h for _, h in want.values()) > 500


def test_no_rows_or_no_keys(spark):
    size = FilterSize.of(300, 0.02)
    rows, keys = spark.createDataFrame([(1, "a"), (2, None)], ROWS), spark.createDataFrame([("a",)], KEYS)
    assert [tuple(r) for r in membership.candidates(rows, keys, size).collect()] == [(1, 1, 1)]
    assert membership.candidates(rows.where("false"), keys, size).count() == 0
    assert membership.candidates(rows, keys.where("false"), size).count() == 0


def test_bloom_candidates_makes_no_row_for_a_pair(spark, tmp_path):
    events = spark.range(30_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id * 7 % 20000 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.range(20_000).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    df = catalog.bloom_candidates(spark, str(tmp_path))
    found = df.collect()
    assert [r["held"] for r in found] == [1000] * 30 and all(r["candidates"] == r["held"] + r["false_positives"] for r in found)
    # 600,000 pairs of a segment and a key, and seven bits of each
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("NestedLoop", "CartesianProduct", "Generate"))
