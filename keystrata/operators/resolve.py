"""From an op-log to the newest version of each key, and what a lookup finds.

An op-log has key, value, expiry_ns, is_deleted and a unique seq. The newest version alone decides: a deleted or expired
newest version hides all older ones, so filters always come after the reduction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NANOS = 1_000_000_000


def newest_first(*by: str) -> Column:
    """The place of a version among its key's, the newest 1."""
    return F.row_number().over(Window.partitionBy("key").orderBy(*(F.desc(c) for c in by or ("seq",))))


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The newest version of each key; Spark keeps one row a key and task before the shuffle."""
    return log.withColumn("_place", newest_first(*by)).where(F.col("_place") == 1).drop("_place")


def shadowed(log: DataFrame) -> DataFrame:
    """All versions but the newest."""
    return log.withColumn("_place", newest_first()).where(F.col("_place") > 1).drop("_place")


def expiry(ttl_s: Column, now_ns: Column) -> Column:
    """Absolute expiry of a time to live in seconds; 0 (never) if it isn't positive."""
    return F.when(ttl_s > 0, now_ns + ttl_s.cast("long") * F.lit(NANOS).cast("long")).otherwise(F.lit(0).cast("long"))


def expired(now_ns: Column) -> Column:
    """Strictly after the expiry; an entry is live at that very instant."""
    return (F.col("expiry_ns") > 0) & (now_ns > F.col("expiry_ns"))


def live(log: DataFrame, now_ns: Column) -> DataFrame:
    """Keys whose newest version is neither deleted nor expired."""
    return latest(log).where(~F.col("is_deleted") & ~expired(now_ns))


def outcome(now_ns: Column) -> Column:
    """What a lookup finds; for a left join of keys with newest versions."""
    return F.when(F.col("seq").isNull(), "missing").when(F.col("is_deleted"), "deleted").when(expired(now_ns), "expired").otherwise("live")


def lookup(keys: DataFrame, log: DataFrame, now_ns: Column) -> DataFrame:
    """Each key with its outcome, and its value where live. Only the keys' own versions are reduced."""
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    found = keys.join(latest(wanted), "key", "left").withColumn("outcome", outcome(now_ns))
    return found.withColumn("value", F.when(F.col("outcome") == "live", F.col("value")))


def first_tier(tiers: Sequence[DataFrame]) -> DataFrame:
    """The version of each key from the first tier that has it, whatever that version is; adds ``tier``.

    Each tier is reduced by itself in the same shuffle: the order is by tier, then by recency inside it.
    """
    parts = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    place = F.row_number().over(Window.partitionBy("key").orderBy("tier", F.desc("seq")))
    return union.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
