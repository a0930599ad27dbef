"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time u in [0, 1], piecewise linear. Its integral is the source's
weight; the weights share ``share`` times all words, and a source's target stops at ``cap`` times its size, the excess
going to the others by weight (water filling). Within a source, documents stand in the order of a digest of their id;
a document's words are taken once per pass over the source until the target is reached, the last one in part.
The cumulative demand at a document's start is inverted through the integrated schedule into its training position u,
and documents are range-sorted by position.

Scale: prefix sums within a source go through ``16 ** DIGITS`` digest buckets, so a source with a third of all rows is
spread over as many tasks as any other rows; only one row a source and bucket is ever summed by source, and one row a
source meets in the water filling. Text is not shuffled by the query; nothing is broadcast but by Spark's own check.

Defined results: null text has size 0; a null source is a source of its own, last in order; a null id sorts like the
empty string; repeated rows are separate documents, told apart only by size; an empty table gives no rows; a source
with no words has target 0. Other columns are carried by :func:`plan_mix` under any names that do not begin ``_mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Knots (u, weight), u ascending from 0 to 1.
Schedule = Sequence[tuple[float, float]]

#: Fixed values of the contract: mean weights 5, 2, 1 by rank of source; here the first fade out and the last fade in.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 7.0), (0.5, 5.0), (1.0, 3.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
SHARE, CAP, DIGITS = 1.5, 2, 3
WORD = r"[^\x20\x09-\x0D]+"


def integral(schedule: Schedule) -> float:
    return sum((v - u) * (a + b) / 2 for (u, a), (v, b) in zip(schedule, schedule[1:], strict=False))


def inverse(schedule: Schedule, fraction: Column) -> Column:
    """The time u by which the schedule has asked for ``fraction`` of its integral."""
    whole, done, out = integral(schedule), 0.0, None
    pieces = []
    for (u, a), (v, b) in zip(schedule, schedule[1:], strict=False):
        area = (v - u) * (a + b) / 2
        y = fraction * F.lit(whole) - F.lit(done)
        slope = (b - a) / (v - u)
        root = F.lit(a) + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2 * slope) * y))
        pieces.append((done + area, F.lit(u) + F.when(root > 0, F.lit(2.0) * y / root).otherwise(F.lit(0.0))))
        done += area
    for upto, u in reversed(pieces):
        out = u if out is None else F.when(fraction * F.lit(whole) <= F.lit(upto), u).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def targets(sizes: DataFrame, schedules: Sequence[Schedule], share: float, cap: int) -> DataFrame:
    """``sizes`` (_mix_source, _mix_source_size), a row a source, with its schedule's number and target."""
    weights = F.array(*(F.lit(integral(s)) for s in schedules))
    all_rows = Window.partitionBy()
    ranked = sizes.withColumn("_mix_rank", F.row_number().over(all_rows.orderBy(F.col("_mix_source"))) - 1)
    ranked = ranked.withColumn("_mix_schedule", F.col("_mix_rank") % len(schedules))
    ranked = ranked.withColumn("_mix_w", F.element_at(weights, F.col("_mix_schedule") + 1))
    ranked = ranked.withColumn("_mix_cap", (F.lit(cap) * F.col("_mix_source_size")).cast("double"))
    by_ratio = all_rows.orderBy(F.col("_mix_cap") / F.col("_mix_w"), "_mix_rank")
    ranked = ranked.withColumn("_mix_total", F.lit(share) * F.sum("_mix_source_size").over(all_rows).cast("double"))
    ranked = ranked.withColumn("_mix_taken", F.sum("_mix_cap").over(by_ratio) - F.col("_mix_cap"))
    ranked = ranked.withColumn("_mix_left", F.sum("_mix_w").over(all_rows) - F.sum("_mix_w").over(by_ratio) + F.col("_mix_w"))
    ranked = ranked.withColumn("_mix_level", (F.col("_mix_total") - F.col("_mix_taken")) / F.col("_mix_left"))
    open_level = F.when(F.col("_mix_level") * F.col("_mix_w") < F.col("_mix_cap"), F.col("_mix_level"))
    ranked = ranked.withColumn("_mix_level", F.max(open_level).over(all_rows))
    goal = F.least(F.col("_mix_cap"), F.coalesce(F.col("_mix_w") * F.col("_mix_level"), F.col("_mix_cap")))
    return ranked.select("_mix_source", "_mix_schedule", goal.alias("_mix_target"))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    schedules: Sequence[Schedule] = SCHEDULES,
    share: float = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """Every row of ``docs`` with _mix_size, _mix_source_size, _mix_target, _mix_taken and _mix_takes.

    _mix_takes has an entry (words, position) for each pass over the source that takes words of the document.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.withColumns({
        "_mix_size": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"),
        "_mix_source": F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1")),
        "_mix_digest": digest,
        "_mix_bucket": F.substring(digest, 1, DIGITS),
    })
    # the key "1" is the null source, after all others, which begin "0"
    cells = sized.groupBy("_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_cell"))
    in_source = Window.partitionBy("_mix_source")
    cells = cells.withColumns({
        "_mix_source_size": F.sum("_mix_cell").over(in_source),
        "_mix_before": F.sum("_mix_cell").over(in_source.orderBy("_mix_bucket")) - F.col("_mix_cell"),
    })
    goals = targets(cells.groupBy("_mix_source").agg(F.max("_mix_source_size").alias("_mix_source_size")), schedules, share, cap)
    goals = goals.select(F.col("_mix_source").alias("_mix_s"), "_mix_schedule", "_mix_target")
    cells = cells.join(goals, F.col("_mix_source") == F.col("_mix_s")).drop("_mix_s", "_mix_cell")
    cells = cells.withColumnsRenamed({"_mix_source": "_mix_s", "_mix_bucket": "_mix_b"})
    in_cell = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_digest", F.col(id_col), "_mix_size")
    in_cell = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_mix_start", F.sum("_mix_size").over(in_cell) - F.col("_mix_size"))
    placed = placed.join(cells, (F.col("_mix_source") == F.col("_mix_s")) & (F.col("_mix_bucket") == F.col("_mix_b")))
    placed = placed.withColumn("_mix_start", F.col("_mix_start") + F.col("_mix_before"))
    goal = F.floor("_mix_target")

    def take(n: int) -> Column:
        at = F.col("_mix_start") + F.lit(n) * F.col("_mix_source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("_mix_size"), goal - at))
        position = F.lit(None).cast("double")
        for i, schedule in reversed(list(enumerate(schedules))):
            position = F.when(F.col("_mix_schedule") == i, inverse(schedule, F.try_divide(at.cast("double"), F.col("_mix_target")))).otherwise(position)
        return F.struct(words.alias("words"), position.alias("position"))

    takes = F.filter(F.array(*(take(n) for n in range(cap))), lambda t: t["words"] > 0)
    placed = placed.withColumn("_mix_takes", takes)
    total = F.aggregate("_mix_takes", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return placed.withColumn("_mix_taken", total).drop("_mix_source", "_mix_digest", "_mix_bucket", "_mix_s", "_mix_b", "_mix_before", "_mix_start", "_mix_schedule")


def training_order(planned: DataFrame, whole: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each time a document is taken, range-sorted by training position, ties by id and a digest of the text.

    ``whole``: documents are not cut; the one on a target's edge is taken if at least half of it lies inside.
    """
    taken = planned.withColumn("_mix_take", F.explode("_mix_takes"))
    if whole:
        taken = taken.where(2 * F.col("_mix_take.words") >= F.col("_mix_size"))
    kept = [c for c in planned.columns if not c.startswith("_mix_")]
    taken = taken.select(*kept, F.col("_mix_take.position").alias("_mix_position"), F.xxhash64(text_col).alias("_mix_digest"))
    return taken.orderBy("_mix_position", id_col, "_mix_digest").drop("_mix_position", "_mix_digest")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    ordered = planned.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        F.col("_mix_taken").alias("taken"),
        F.round(F.get(F.col("_mix_takes"), F.lit(0))["position"], 6).alias("position"),
    )
    return ordered.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap,
           row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
    FROM sources
), weighed AS (
    SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM ranked
), levels AS (
    SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER by_ratio - cap))
              / (sum(w) OVER () - sum(w) OVER by_ratio + w) AS level
    FROM weighed
    WINDOW by_ratio AS (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING)
), goals AS (
    SELECT source, source_size,
           least(cap, coalesce(w * max(CASE WHEN level * w < cap THEN level END) OVER (), cap)) AS target
    FROM levels
), placed AS (
    SELECT doc_id, source, size, (SELECT count(*) FROM sources s WHERE s.source < sized.source OR s.source IS NOT NULL AND sized.source IS NULL) % 3 AS schedule,
           CAST(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
    FROM sized
)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, CAST(floor(target) AS BIGINT) - start))
       + greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - source_size)) AS taken,
       round(CASE WHEN size > 0 AND floor(target) > start THEN
           CASE schedule WHEN 0 THEN 10 * (start / target) / (7 + sqrt(49 - 40 * (start / target)))
                         WHEN 1 THEN start / target
                         ELSE 2 * (start / target) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * (start / target))) END END, 6) AS position
FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source
"""
