"""Sizes, offsets, counters and sample statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.hashing import entry_bytes


#: Blocks that are summed together before one row of them meets all others.
BLOCKS = 4096


def running_before(df: DataFrame, value: Column, order: str, block: Column, name: str = "offset") -> DataFrame:
    """The sum of ``value`` over all rows before, in the order of a unique column, without one task that sees all rows.

    ``block``, a whole number, rises with the order: sums are taken inside blocks, inside groups of ``BLOCKS`` blocks, and
    over one row a group. With blocks of 4096 rows, 10**12 rows are 60,000 such rows.
    """
    rows = df.withColumns({"_value": value.cast("long"), "_block": block.cast("long")})
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_inside", F.sum("_value").over(inside) - F.col("_value"))
    blocks = df.select(value.cast("long").alias("_value"), block.cast("long").alias("_b")).groupBy("_b").agg(F.sum("_value").alias("_total"))
    blocks = blocks.withColumn("_g", F.floor(F.col("_b") / BLOCKS))
    groups = blocks.groupBy("_g").agg(F.sum("_total").alias("_whole"))
    groups = groups.select(F.col("_g").alias("_of"), (F.sum("_whole").over(Window.orderBy("_g")) - F.col("_whole")).alias("_earlier"))
    within = F.sum("_total").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_total")
    blocks = blocks.withColumn("_before", within).join(groups, F.col("_g") == F.col("_of")).select("_b", (F.col("_before") + F.col("_earlier")).alias("_before"))
    joined = rows.join(blocks, F.col("_block") == F.col("_b"))
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_value", "_block", "_b", "_inside", "_before")


def net_bytes(latest: DataFrame) -> Column:
    """What the newest versions are charged with: overwritten versions don't count."""
    return F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("bytes")


def sample_statistics(sample: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """n, least, most, mean, median, p95 and p99 of a sample, by places in its sorted order.

    p95 is the value at place int(0.95 n) from 0 if n > 20, p99 that at int(0.99 n) if n > 100, else the largest. Values
    are counted, and places are running sums of counts over ranges between approximate quantiles, so no task holds the
    sample, whatever its shape; the places are exact.
    """
    x = sample.select(F.col(column).alias("x")).where(F.col("x").isNotNull())
    totals = x.agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.avg("x"), 6).alias("mean"))
    counted = x.groupBy("x").agg(F.count("*").alias("times"))
    edges = x.agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("edges"))
    # the number of edges up to x, by halving steps
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((buckets - 1).bit_length()))))
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("edges", at + step - 1) <= F.col("x"), at + step).otherwise(at))
    # one row of edges goes to all tasks
    counted = counted.crossJoin(F.broadcast(edges)).select("x", "times", bucket.alias("bucket"))
    placed = running_before(counted, F.col("times"), "x", F.col("bucket"), "first")
    n = x.agg(F.count("*")).scalar()

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("first") <= place) & (place < F.col("first") + F.col("times")), F.col("x")))

    middle = [F.floor((n - 1) / 2), F.floor(n / 2)]
    picked = placed.agg(
        ((at(middle[0]) + at(middle[1])) / 2).alias("median"),
        at(F.when(n > 20, F.floor(n * F.lit(0.95))).otherwise(n - 1)).alias("p95"),
        at(F.when(n > 100, F.floor(n * F.lit(0.99))).otherwise(n - 1)).alias("p99"),
    )
    return totals.join(picked)
