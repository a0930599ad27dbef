"""Hashes and membership positions as SQL expressions, all inside the JVM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a offset basis and prime of the published algorithm.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619

# Parts a membership filter is split into, least bits, most bits; keys and rate where none are given.
FILTER_PARTS = 32
FILTER_LEAST_BITS = 64
FILTER_MOST_BITS = 16 * 2**30
FILTER_DEFAULTS = (1000, 0.01)


def fnv1a32(key: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a long from 0 to 2**32 - 1; the empty key gives the offset basis."""
    coded = F.encode(key, "UTF-8")

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(coded, i, F.lit(1))), 16, 10).cast("long")
        return (h.bitwiseXOR(byte) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    places = F.sequence(F.lit(1), F.octet_length(key))
    return F.when(F.octet_length(key) == 0, F.lit(FNV_OFFSET).cast("long")).otherwise(F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), step))


def shard(key: Column, n: int) -> Column:
    """The shard of a key among ``n``."""
    return (fnv1a32(key) % F.lit(n)).cast("int")


def entry_bytes(key: Column, value: Column) -> Column:
    """Size that an entry is charged with in memory: the bytes of key and value and 16."""
    return (F.octet_length(key) + F.octet_length(value) + F.lit(16)).cast("long")


def record_bytes(key: Column, value: Column) -> Column:
    """Size of a record in the binary log and in a segment file: a 17-byte header, key and value."""
    return (F.octet_length(key) + F.octet_length(value) + F.lit(17)).cast("long")


@dataclass(frozen=True)
class FilterSize:
    """Bits of a membership filter, in equal parts, and probes of a key."""

    bits: int
    probes: int
    part_bits: int

    @classmethod
    def of(cls, n: int, rate: float) -> FilterSize:
        """For n keys at a false-positive rate: the optimum. Bits are kept within the fixed bounds; probes are those of the
        optimum, whatever the bounds. Without a positive number of keys or rate, those of ``FILTER_DEFAULTS`` hold."""
        n, rate = n if n > 0 else FILTER_DEFAULTS[0], rate if rate > 0 else FILTER_DEFAULTS[1]
        best = -n * math.log(rate) / math.log(2) ** 2
        bits = min(max(math.ceil(best), FILTER_LEAST_BITS), FILTER_MOST_BITS)
        return cls(bits, max(1, math.ceil(best / n * math.log(2))), max(1, -(-bits // FILTER_PARTS)))


def filter_hash(segment: Column, key: Column) -> Column:
    """The CRC-32 that a segment's key is found by."""
    return F.crc32(F.encode(F.concat(segment.cast("string"), F.lit(":"), key), "UTF-8"))


def filter_positions(segment: Column, key: Column, size: FilterSize) -> Column:
    """The bits that a key of a segment sets: double hashing of a CRC-32, inside the segment's part."""
    h = filter_hash(segment, key)
    high = F.shiftright(h, 16)
    part = F.pmod(segment, F.lit(FILTER_PARTS)).cast("long") * F.lit(size.part_bits)
    return F.transform(F.sequence(F.lit(0), F.lit(size.probes - 1)), lambda i: part + F.pmod(h + i * high, F.lit(size.part_bits).cast("long")))
