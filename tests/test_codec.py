"""Binary layouts: byte-exact records, round trips with values, torn tails."""

import pytest
from pyspark.sql import functions as F

from keystrata.sources import codec, oplog

ROWS = [("a", b"val", 0, False, 0), ("é", b"", 7, True, 1), ("", b"\x00q\"\n", -1, False, 2), ("z" * 300, b"x" * 1000, 2**62, False, 3)]
SCHEMA = "key string, value binary, expiry_ns long, is_deleted boolean, seq long"


def test_layouts():
    assert codec.log_record(b"k", b"vv", 1, True) == b"\x01\0\0\0k\x02\0\0\0vv\x01\0\0\0\0\0\0\0\x01"
    assert codec.segment_record(b"k", b"vv", 1, True) == b"\x01\0\0\0\x02\0\0\0\x01\0\0\0\0\0\0\0\x01kvv"


def test_log_round_trip(spark):
    log = spark.createDataFrame(ROWS, SCHEMA)
    back = codec.decode(codec.encode_log(log, F.lit(0).cast("long"), file_bytes=40), codec.read_log).collect()
    assert sorted((r["key"], bytes(r["value"]), r["expiry_ns"], r["is_deleted"]) for r in back) == sorted(r[:4] for r in ROWS)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "log.12").write_bytes(b"".join(codec.log_record(k.encode(), v, e, d) for k, v, e, d, _ in ROWS))
    back = codec.read_log_files(spark, str(tmp_path)).collect()
    assert {r["file"] for r in back} == {12} and [bytes(r["value"]) for r in sorted(back, key=lambda r: r["offset"])] == [r[1] for r in ROWS]
    (tmp_path / "L0_77.sst").write_bytes(b"".join(codec.segment_record(k.encode(), v, e, d) for k, v, e, d, _ in ROWS))
    segments = codec.read_segment_files(spark, str(tmp_path / "L0_77.sst")).collect()
    assert {r["file"] for r in segments} == {77} and len(segments) == len(ROWS)


def test_torn_tail(spark, tmp_path):
    (tmp_path / "log").write_bytes(codec.log_record(b"k", b"v", 0, False) + b"\xff\xff\xff")
    with pytest.raises(Exception, match="ends inside"):
        codec.read_log_files(spark, str(tmp_path)).collect()
    rows = codec.read_log_files(spark, str(tmp_path), lenient=True).collect()
    assert [(r["key"], r["torn"]) for r in rows] == [("k", True)]


@pytest.mark.parametrize("cut", [1, 4, 9, 20])
def test_every_cut_keeps_the_whole_records(cut):
    data = codec.log_record(b"key", b"value", 5, False) * 3
    rows = []
    with pytest.raises(codec.TornRecord):
        rows.extend(x for x in codec.read_log(data[:-cut]))
    good = list(zip(codec.read_log(data[: 2 * len(data) // 3]), range(2), strict=False))
    assert len(good) == 2


def test_requests(spark):
    bodies = [(0, '{"key": "a", "value": "x\\"y", "ttl": 3}'), (1, "{bad}"), (2, '{"key": "b"}')]
    got = {r["i"]: (r["status"], r["key"], r["value"], r["ttl"]) for r in oplog.parse_puts(spark.createDataFrame(bodies, "i int, body string")).collect()}
    assert got == {0: (201, "a", 'x"y', 3), 1: (400, None, None, None), 2: (201, "b", "", 0)}
    batch = spark.createDataFrame([(5, '{"items": [{"key": "a", "value": "1"}, {"key": "a", "value": "2", "ttl": 4}]}')], "batch int, body string")
    assert [tuple(r) for r in oplog.unpack_batches(batch).collect()] == [(5, 0, "a", "1", 0), (5, 1, "a", "2", 4)]


def test_file_numbers(spark):
    names = [("L0_123.sst", 123), ("wal.456", 456), ("other.sst", 0), ("L0_99999999999999999999.sst", 0)]
    got = spark.createDataFrame(names, "p string, n long").select(codec.file_number(F.col("p")).alias("g"), "n").collect()
    assert all(r["g"] == r["n"] for r in got)


def test_written_files_read_back(spark, tmp_path):
    log = spark.createDataFrame(ROWS, SCHEMA)
    names = codec.write_files(codec.encode_log(log, F.floor(F.col("seq") / 2), file_bytes=1), str(tmp_path / "wal"), "wal.{}")
    assert names == ["wal.0", "wal.1", "wal.10000", "wal.10001"]
    back = codec.read_log_files(spark, str(tmp_path / "wal")).collect()
    assert [r["key"] for r in sorted(back, key=lambda r: r["file"])] == [r[0] for r in ROWS]
    assert codec.write_files(codec.encode_segments(log.withColumn("segment", F.lit(3).cast("long"))), str(tmp_path / "sst"), "L0_{}.sst") == ["L0_30000.sst"]
    segment = codec.read_segment_files(spark, str(tmp_path / "sst")).orderBy("offset").collect()
    assert [r["key"] for r in segment] == sorted(r[0] for r in ROWS)
