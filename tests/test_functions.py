"""Hashes, filters, folds and statistics against plain Python."""

import random
import statistics
import zlib

import pytest
from pyspark.sql import functions as F

from keystrata.functions.hashing import FilterSize, filter_positions, fnv1a32
from keystrata.operators import accounting, sequential


def fnv(data):
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv(spark):
    keys = ["", "a", "user:7", "é𝄞", "x" * 200]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fnv1a32(F.col("k")).alias("h")).collect()
    assert {r["k"]: r["h"] for r in got} == {k: fnv(k.encode()) for k in keys}


def test_filter_size():
    size = FilterSize.of(10_000_000, 0.01)
    assert (size.bits, size.probes, size.part_bits) == (95_850_584, 7, 2_995_331)
    # no keys or no rate: the defaults; few keys: the probes of the optimum, though the bits are raised
    assert FilterSize.of(0, 0.01) == FilterSize.of(1000, 0.01) == FilterSize.of(-3, 0) and FilterSize.of(0, 0.01).bits == 9586
    assert [(FilterSize.of(n, 0.01).bits, FilterSize.of(n, 0.01).probes) for n in (1, 3, 100)] == [(64, 7), (64, 7), (959, 7)]
    assert FilterSize.of(1000, 0.5).probes == 1


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    size = FilterSize.of(32_000, 0.05)
    keys = spark.range(3000).select(F.lit(3).alias("s"), F.concat(F.lit("k"), F.col("id")).alias("k"), "id")
    rows = keys.select("id", "k", filter_positions(F.col("s"), F.col("k"), size).alias("p")).collect()
    h = zlib.crc32(b"3:k0")
    assert rows[0]["p"] == [3 * size.part_bits + (h + i * (h >> 16)) % size.part_bits for i in range(size.probes)]
    held = {b for r in rows if r["id"] < 1000 for b in r["p"]}
    assert all(set(r["p"]) <= held for r in rows if r["id"] < 1000)
    assert sum(set(r["p"]) <= held for r in rows if r["id"] >= 1000) < 0.2 * 2000


def test_recent_keys():
    cache = sequential.RecentKeys(2)
    assert cache.put("k1", 1) is None and cache.put("k2", 2) is None
    assert cache.get("k1") == 1 and cache.put("k3", 3) == "k2"
    cache.remove("k1")
    assert cache.get("k1") is None and cache.get("k3") == 3


def cached(spark, ops, capacity):
    rows = sequential.simulate_cache(spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "seq long, key string, is_read boolean, is_live boolean"), capacity).collect()
    return [(r["hit"], r["evicted"]) for r in rows]


def test_cache_simulation(spark):
    ops = [("a", True), ("a", True), ("b", True), ("c", True), ("a", True), ("c", False), ("c", True)]
    assert cached(spark, [(*o, True) for o in ops], 2) == [(False, None), (True, None), (False, None), (False, "a"), (False, "b"), (False, None), (False, None)]


def test_what_is_not_live_fills_no_cache(spark):
    ops = [("a", True, False), ("a", True, False), ("b", True, True), ("c", True, True), ("a", True, False), ("b", True, True)]
    assert cached(spark, ops, 2) == [(False, None), (False, None), (False, None), (False, None), (False, None), (True, None)]
    # an entry that expires is dropped by the read that finds it so, and frees its place
    ops = [("a", True, True), ("b", True, True), ("a", True, False), ("c", True, True), ("b", True, True)]
    assert cached(spark, ops, 2) == [(False, None), (False, None), (False, None), (False, None), (True, None)]


def test_rotation(spark):
    rows = [("k", "v" * 20, i) for i in range(3)] + [("other", "v" * 40, 3), ("k", "", 4)]
    got = sequential.rotations(spark.createDataFrame(rows, "key string, value string, seq long"), 60).collect()
    assert [(r["first_seq"], r["last_seq"], r["n_keys"], r["bytes"], r["frozen"]) for r in got] == [(0, 3, 2, 37 + 61, True), (4, 4, 1, 17, False)]


def test_running_sums(spark):
    values = [random.Random(4).randrange(100) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    got = accounting.running_before(df, F.col("v"), "i", F.floor(F.col("i") / 64)).collect()
    assert {r["i"]: r["offset"] for r in got} == {i: sum(values[:i]) for i in range(500)}


def test_running_sums_over_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(accounting, "BLOCKS", 3)
    df = spark.range(300).withColumnRenamed("id", "i")
    got = accounting.running_before(df, F.col("i") % 7, "i", F.floor(F.col("i") / 8)).collect()
    assert {r["i"]: r["offset"] for r in got} == {i: sum(j % 7 for j in range(i)) for i in range(300)}


def test_statistics_of_a_long_tail(spark):
    x = [float(i) for i in range(400)] + [1e300]
    got = accounting.sample_statistics(spark.createDataFrame([(v,) for v in x], "v double"), "v", 32).first()
    assert (got["median"], got["p95"], got["p99"], got["most"]) == (200.0, 380.0, 396.0, 1e300)


@pytest.mark.parametrize("n", [1, 2, 20, 21, 101, 250])
def test_sample_statistics(spark, n):
    x = [round(random.Random(n).gauss(5, 3), 1) for _ in range(n)]
    s = sorted(x)
    got = accounting.sample_statistics(spark.createDataFrame([(v,) for v in x], "v double"), "v", 16).first()
    assert (got["n"], got["least"], got["most"]) == (n, s[0], s[-1])
    assert got["median"] == pytest.approx(statistics.median(x)) and got["mean"] == pytest.approx(statistics.mean(x), abs=1e-6)
    assert got["p95"] == (s[int(n * 0.95)] if n > 20 else s[-1]) and got["p99"] == (s[int(n * 0.99)] if n > 100 else s[-1])
