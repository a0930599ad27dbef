"""The store: any schedule of flushes and compactions gives the same state; readers are pinned; all survives reopening."""

import random

import pytest

from keystrata.plans.store import SCHEMA, Options, Store
from keystrata.streaming import upsert
from tests.test_resolve import model, random_log


def state(store, now_ns=100):
    return {r["key"]: r["value"] for r in store.state().collect() if not r["is_deleted"] and not (0 < r["expiry_ns"] < now_ns)}


@pytest.mark.parametrize("seed", range(2))
def test_any_schedule_gives_the_same_state(spark, tmp_path, seed):
    rows, pick = random_log(seed, 120), random.Random(seed)
    store = Store(spark, str(tmp_path / "s"), Options(compact_at=2))
    for at in range(0, 120, 30):
        store.append(spark.createDataFrame([(*r[:4], i) for i, r in enumerate(rows[at : at + 30])], SCHEMA))
        if pick.random() < 0.7:
            store.flush()
        if pick.random() < 0.6:
            store.compact()
    assert state(store) == model(rows, 100)
    assert state(Store(spark, str(tmp_path / "s"))) == model(rows, 100)


def test_put_get_delete(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.get("a", 0) is None
    store.put("a", "1")
    store.put("a", "2", ttl=1, now_ns=0)
    assert store.get("a", 10**9) == "2" and store.get("a", 10**9 + 1) is None
    store.delete("a")
    assert store.get("a", 0) is None
    store.put("a", "3")
    store.flush()
    assert Store(spark, str(tmp_path / "s")).get("a", 0) == "3"


def test_newest_wins_over_many_segments_and_tombstones_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(compact_at=4))
    for i in range(4):
        store.append(spark.createDataFrame([("shared", f"v{i}", 0, False, 0), (f"own{i}", "x", 0, i == 2, 1)], SCHEMA))
        store.flush()
        assert len(store.compact().at(0)) == (0 if i == 3 else i + 1)
    rows = {r["key"]: r for r in store.log().collect()}
    assert len(rows) == 5 and rows["shared"]["value"] == "v3" and rows["own2"]["is_deleted"]
    store.delete("shared")
    store.flush()
    store.compact(force=True, purge_at_ns=0)
    assert {r["key"] for r in store.log().collect()} == {"own0", "own1", "own3"}


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put("a", "1")
    pinned = store.manifest
    store.put("a", "2")
    store.flush()
    assert [r["value"] for r in store.state(pinned).collect()] == ["1"]
    assert len(store.vacuum()) == 2 and store.get("a", 0) == "2"


def test_flush_threshold(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(flush_bytes=10))
    store.put("k", "x" * 20)
    assert [s.level for s in store.manifest.segments] == [0]


def test_options_overlay():
    assert Options.of({"compact_at": 2, "unknown": 1}) == Options(compact_at=2)


def test_settings_from_a_file(spark, tmp_path):
    (tmp_path / "config.json").write_text('{\n "maximum_memtable_size_in_bytes": 10, "key_cache_capacity_count": 3,\n "server_port": 8080, "bloom_filter_false_positive_rate": 0.05}')
    assert Options.read(spark, str(tmp_path / "config.json")) == Options(flush_bytes=10, cache_keys=3, bloom_rate=0.05)
    (tmp_path / "bad.json").write_text("{bad}")
    with pytest.raises(ValueError):
        Options.read(spark, str(tmp_path / "bad.json"))


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    for i in range(3):
        one.put(f"a{i}", "1")
        two.put(f"b{i}", "2")  # was opened before the other's commit: it tries again after it
    one.put("same", "old")
    two.put("same", "new")
    assert state(Store(spark, str(tmp_path / "s"))) == {"a0": "1", "a1": "1", "a2": "1", "b0": "2", "b1": "2", "b2": "2", "same": "new"}
    assert two.manifest.version == 8 and len({s.segment_id for s in two.manifest.segments}) == 8


def test_a_merge_keeps_what_others_commit_and_gives_way_to_another_merge(spark, tmp_path):
    one = Store(spark, str(tmp_path / "s"))
    one.put("a", "1")
    one.put("a", "2")
    two = Store(spark, str(tmp_path / "s"))
    two.put("b", "3")
    one.flush()  # of the two it knows; the third stays
    assert state(Store(spark, str(tmp_path / "s"))) == {"a": "2", "b": "3"} and len(one.manifest.at(0)) == 1 and len(one.manifest.at(-1)) == 1
    stale = Store(spark, str(tmp_path / "s"))
    two = Store(spark, str(tmp_path / "s"))
    two.compact(force=True)
    stale.compact(force=True)
    assert state(Store(spark, str(tmp_path / "s"))) == {"a": "2", "b": "3"} and len(stale.manifest.at(1)) == 1


def test_a_crash_before_the_rename_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put("a", "1")
    (tmp_path / "s" / "_manifest.half").write_text('{"version": 2')
    assert state(Store(spark, str(tmp_path / "s"))) == {"a": "1"}


def test_batches_metrics_and_the_key_cache(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(cache_keys=2))
    store.put_batch([{"key": "a", "value": "1"}, {"key": "b"}, {"key": "a", "value": "2", "ttl": 1}])
    assert store.put_batch([]).version == 1
    assert store.get("a", 0) == "2" and store.get("a", 10**9 + 1) is None and store.get("b", 0) == "" and store.get("x", 0) is None
    keys = spark.createDataFrame([("a",), ("x",)], "key string")
    assert {r["key"]: r["outcome"] for r in store.get_many(keys, 10**9 + 1).collect()} == {"a": "expired", "x": "missing"}
    assert store.metrics() | {"rows": 3, "bytes": 53, "segments_at_memory": 1, "writes": 3, "reads": 4, "cache_hits": 1, "found": 2, "missing": 2} == store.metrics()
    store.put("a", "3")
    assert store.get("a", 10**9 + 1) == "3"


def test_a_stream_into_a_store(spark, tmp_path):
    rows = random_log(5, 90)
    for at in range(0, 90, 30):
        spark.createDataFrame(rows[at : at + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = Store(spark, str(tmp_path / "s"))
        upsert.ingest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), store, str(tmp_path / "checkpoint"))
    assert state(Store(spark, str(tmp_path / "s"))) == model(rows, 100)
