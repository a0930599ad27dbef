"""Membership filters of segments, and what they let through."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.hashing import FilterSize, filter_hash

WORD = 64
#: Keys that are looked up at once; their places stay in a core's cache.
CHUNK = 32_768


def _named(rows: DataFrame) -> DataFrame:
    return rows.where("segment IS NOT NULL AND key IS NOT NULL").select("segment", "key")


def filters(rows: DataFrame, size: FilterSize) -> DataFrame:
    """segment, and the bits that its keys set in its part (as ``filter_positions`` has them) as an array of longs; segments
    without a key have no row."""
    part = F.lit(size.part_bits).cast("long")
    h = filter_hash(F.col("segment"), F.col("key"))
    probes = _named(rows).select("segment", (h % part).alias("start"), (F.shiftright(h, 16) % part).alias("step"))
    places = [(F.col("start") + F.col("step") * F.lit(i).cast("long")) % part for i in range(size.probes)]
    bits = probes.select("segment", F.explode(F.array(*places)).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % WORD).cast("int"))
    words = bits.groupBy("segment", F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    whole = words.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    every = F.sequence(F.lit(0), F.lit(-(-size.part_bits // WORD) - 1))
    return whole.select("segment", F.transform(every, lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long"))).alias("words"))


def key_shift(segment: int, length: int) -> int:
    """The exclusive or of ``filter_hash`` and the key's own CRC-32. A CRC is linear, so this is one number for all keys of a
    length in bytes, and is read off the key of that many zeros."""
    zeros = b"0" * length
    return zlib.crc32(zeros, zlib.crc32(f"{segment}:".encode())) ^ zlib.crc32(zeros)


def _start_and_step(h: np.ndarray, size: FilterSize) -> list[np.ndarray]:
    part = np.uint32(size.part_bits)
    return [(x - x // part * part).astype(np.intp) for x in (h, h >> np.uint32(16))]


def _passes(h: np.ndarray, table: np.ndarray, size: FilterSize) -> np.ndarray:
    """Which of the hashes have all bits set in ``table``: a filter's bits, ``probes`` times in a row."""
    at, step = _start_and_step(h, size)
    found = table.take(at, mode="clip")
    for _ in range(size.probes - 1):
        at += step
        found &= table.take(at, mode="clip")
    return found


def candidates(rows: DataFrame, keys: DataFrame, size: FilterSize) -> DataFrame:
    """For each segment of ``rows`` (segment, key), how many different ``keys`` (key) its filter can't exclude, and how many of
    these it holds. Every key meets every filter, but as one number: its CRC-32 is taken once, ``key_shift`` makes it that
    of each segment, and no row is made for a pair. The filters (part_bits / 8 bytes each) go to all tasks by the driver."""
    spark = rows.sparkSession
    built = filters(rows, size).toArrow()
    order = np.argsort(segments := built["segment"].to_numpy())
    words = built["words"].combine_chunks().flatten().to_numpy().reshape(len(segments), -(-size.part_bits // WORD))
    shared = spark.sparkContext.broadcast((segments[order], words[order]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["crc"].to_numpy().astype(np.uint32), b["length"].to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        crc, length = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(length, kind="stable")
        crc, length = crc[order], length[order]
        # chunks of keys by length: how many of each
        parts = [(crc[at : at + CHUNK], *np.unique(length[at : at + CHUNK], return_counts=True)) for at in range(0, len(crc), CHUNK)]
        lengths = np.unique(length)
        segments, words = shared.value
        found = np.zeros(len(segments), np.int64)
        for i, segment in enumerate(segments):
            bits = np.unpackbits(words[i].astype("<i8").view(np.uint8), bitorder="little")[: size.part_bits]
            table = np.tile(bits.astype(bool), size.probes)
            shifts = np.array([key_shift(int(segment), int(n)) for n in lengths], np.uint32)
            found[i] = sum(np.count_nonzero(_passes(own ^ np.repeat(shifts[np.searchsorted(lengths, some)], n), table, size)) for own, some, n in parts)
        yield pa.RecordBatch.from_arrays([pa.array(segments), pa.array(found)], names=["segment", "n"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, words = shared.value
        for b in batches:
            place = np.searchsorted(segments, b["segment"].to_numpy())
            start, step = _start_and_step(b["h"].to_numpy().astype(np.uint32), size)
            found = np.ones(b.num_rows, bool)
            for i in range(size.probes):
                bit = (start + i * step) % size.part_bits
                found &= (words[place, bit // WORD] >> bit % WORD & 1).astype(bool)
            own, n = np.unique(place[found], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(segments[own]), pa.array(n.astype(np.int64))], names=["segment", "n"])

    def summed(counts: DataFrame, name: str) -> DataFrame:
        return counts.groupBy("segment").agg(F.sum("n").alias(name)).where(F.col(name) > 0)

    keys = keys.where("key IS NOT NULL").select("key")
    # by number: a few bytes of keys are as much work as there are filters
    dealt = keys.repartition(2 * spark.sparkContext.defaultParallelism, "key").distinct()
    met = dealt.select(F.crc32(F.encode("key", "UTF-8")).alias("crc"), F.octet_length("key").alias("length")).mapInArrow(count, "segment long, n long")
    asked = _named(rows).distinct().join(keys, "key", "left_semi").select("segment", filter_hash(F.col("segment"), F.col("key")).alias("h"))
    held = summed(asked.mapInArrow(look_up, "segment long, n long"), "held")
    return summed(met, "candidates").join(held, "segment", "left").select("segment", "candidates", F.coalesce("held", F.lit(0).cast("long")).alias("held"))
