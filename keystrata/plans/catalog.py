"""The engine's queries, each over whole tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.hashing import FilterSize, entry_bytes, fnv1a32, record_bytes, shard
from keystrata.operators import accounting, membership, resolve, sequential
from keystrata.plans.store import Options, Store
from keystrata.sources import codec, oplog
from keystrata.sources.oplog import table
from keystrata.streaming import upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEGMENT_ROWS, GROUP_ROWS, BATCH_ROWS, SHARDS, TABLE_SHARDS = 1000, 101, 100, 8, 32
FLUSH_BYTES, CACHE_KEYS, BLOCK = 2048, 16, 4096

#: The op-log of ``events`` in SQL, and the last instant.
LOG = """
WITH oplog AS (
    SELECT event_id AS seq, 'user:' || user_id AS key, event_type = 'error' AS is_deleted, event_type, ts,
           CASE WHEN event_type = 'error' THEN '' ELSE props END AS value,
           CASE WHEN event_type = 'signup' THEN epoch_us(ts) * 1000 + 86400000000000 ELSE 0::BIGINT END AS expiry_ns
    FROM events
), instant AS (SELECT max(epoch_us(ts)) * 1000 AS now_ns FROM events),
latest AS (SELECT * FROM oplog QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
segments AS (SELECT *, seq // 1000 AS segment FROM oplog QUALIFY row_number() OVER (PARTITION BY seq // 1000, key ORDER BY seq DESC) = 1)
"""


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL after LOG (or alone, if it begins with WITH)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith("WITH") else LOG + sql
        return f

    return add


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.event_log(table(spark, sf_dir, "events"))


def now(spark: SparkSession, sf_dir: str) -> Column:
    return oplog.last_instant(table(spark, sf_dir, "events"))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each key in each segment of consecutive operations."""
    log = events_log(spark, sf_dir).withColumn("segment", F.floor(F.col("seq") / SEGMENT_ROWS))
    place = F.row_number().over(Window.partitionBy("segment", "key").orderBy(F.desc("seq")))
    return log.withColumn("_place", place).where("_place = 1").drop("_place")


def tiers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    log = events_log(spark, sf_dir)
    return [log.where("seq >= 8000"), log.where("seq >= 4000 AND seq < 8000"), log.where("seq < 4000")]


# lookups


@query("SELECT key, value, expiry_ns, seq FROM latest, instant WHERE NOT is_deleted AND NOT (expiry_ns > 0 AND now_ns > expiry_ns)")
def kv_live_snapshot(spark, sf_dir):
    return resolve.live(events_log(spark, sf_dir), now(spark, sf_dir)).select("key", "value", "expiry_ns", "seq")


@query("SELECT key, value, expiry_ns, is_deleted, seq FROM latest")
def kv_upsert_latest(spark, sf_dir):
    return resolve.latest(events_log(spark, sf_dir)).select("key", "value", "expiry_ns", "is_deleted", "seq")


@query("""
, puts AS (
    SELECT *, seq // 100 AS batch, row_number() OVER (PARTITION BY seq // 100 ORDER BY seq) - 1 AS pos,
           CAST(CASE WHEN event_type = 'signup' THEN 86400 ELSE 0 END AS INTEGER) AS ttl
    FROM oplog WHERE NOT is_deleted
)
SELECT key, value, ttl, batch, pos FROM puts QUALIFY row_number() OVER (PARTITION BY key ORDER BY batch DESC, pos DESC) = 1
""")
def kv_batch_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    item = F.struct(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("props").alias("value"), F.when(F.col("event_type") == "signup", 86400).otherwise(0).alias("ttl"))
    batches = events.groupBy(F.floor(F.col("event_id") / BATCH_ROWS).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))).alias("rows"))
    requests = batches.select("batch", F.to_json(F.struct(F.col("rows.item").alias("items"))).alias("body"))
    return resolve.latest(oplog.unpack_batches(requests), "batch", "pos").select("key", "value", "ttl", "batch", "pos")


@query("SELECT key, value FROM latest, instant WHERE key IN ('user:7', 'user:-1') AND NOT is_deleted AND NOT (expiry_ns > 0 AND now_ns > expiry_ns)")
def kv_point_get(spark, sf_dir):
    # the filter on the key passes below the reduction into the scan
    return resolve.live(events_log(spark, sf_dir), now(spark, sf_dir)).where(F.col("key").isin("user:7", "user:-1")).select("key", "value")


@query("""
SELECT k.key, CASE WHEN NOT is_deleted AND NOT (expiry_ns > 0 AND now_ns > expiry_ns) THEN value END AS value
FROM (SELECT 'user:' || range AS key FROM range(-1, 20)) k LEFT JOIN latest ON k.key = latest.key, instant
""")
def kv_multi_get(spark, sf_dir):
    keys = spark.range(-1, 20).select(F.concat(F.lit("user:"), F.col("id")).alias("key"))
    return resolve.lookup(keys, events_log(spark, sf_dir), now(spark, sf_dir)).select("key", "value")


@query("""
SELECT k.key, CASE WHEN seq IS NULL THEN 'missing' WHEN is_deleted THEN 'deleted' WHEN expiry_ns > 0 AND now_ns > expiry_ns THEN 'expired' ELSE 'live' END AS outcome
FROM (SELECT 'user:' || range AS key FROM range(-1, 200)) k LEFT JOIN latest ON k.key = latest.key, instant
""")
def kv_get_outcome(spark, sf_dir):
    keys = spark.range(-1, 200).select(F.concat(F.lit("user:"), F.col("id")).alias("key"))
    return resolve.lookup(keys, events_log(spark, sf_dir), now(spark, sf_dir)).select("key", "outcome")


@query("""
SELECT key, '{"key":"' || key || '","val":"' || replace(replace(value, '\\', '\\\\'), '"', '\\"') || '"}' AS body
FROM latest, instant WHERE NOT is_deleted AND NOT (expiry_ns > 0 AND now_ns > expiry_ns)
""")
def kv_get_json(spark, sf_dir):
    found = resolve.live(events_log(spark, sf_dir), now(spark, sf_dir))
    return found.select("key", F.to_json(F.struct("key", F.col("value").alias("val"))).alias("body"))


@query("SELECT key, seq FROM latest WHERE is_deleted")
def kv_tombstones(spark, sf_dir):
    return resolve.latest(events_log(spark, sf_dir)).where("is_deleted").select("key", "seq")


@query("""
SELECT event_id AS seq, 'user:' || user_id AS key, ttl, CASE WHEN ttl > 0 THEN epoch_us(ts) * 1000 + ttl * 1000000000::BIGINT ELSE 0::BIGINT END AS expiry_ns
FROM (SELECT *, CAST(CASE event_type WHEN 'signup' THEN 86400 WHEN 'click' THEN -5 ELSE 0 END AS INTEGER) AS ttl FROM events)
""")
def kv_ttl_expiry(spark, sf_dir):
    ttl = F.when(F.col("event_type") == "signup", 86400).when(F.col("event_type") == "click", -5).otherwise(0)
    events = table(spark, sf_dir, "events").withColumn("ttl", ttl)
    expiry = resolve.expiry(F.col("ttl"), oplog.unix_nanos(F.col("ts")))
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"), "ttl", expiry.alias("expiry_ns"))


@query("SELECT key, seq, expiry_ns FROM latest, instant WHERE NOT is_deleted AND expiry_ns > 0 AND now_ns > expiry_ns")
def kv_ttl_expired(spark, sf_dir):
    found = resolve.latest(events_log(spark, sf_dir)).where(~F.col("is_deleted") & resolve.expired(now(spark, sf_dir)))
    return found.select("key", "seq", "expiry_ns")


@query("SELECT key, seq FROM oplog QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) > 1")
def kv_shadowed_versions(spark, sf_dir):
    return resolve.shadowed(events_log(spark, sf_dir)).select("key", "seq")


@query("""
SELECT event_id AS seq, 'put' AS method, CAST(CASE WHEN event_id % 10 = 0 THEN 400 ELSE 201 END AS INTEGER) AS status FROM events
UNION ALL SELECT event_id, 'get', CAST(CASE WHEN event_id % 7 = 0 THEN 400 ELSE 200 END AS INTEGER) FROM events
""")
def kv_reject_invalid(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("props").alias("value")))
    puts = oplog.parse_puts(events.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 0, "{bad}").otherwise(good).alias("body")))
    keys = events.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("user:"), F.col("user_id"))).alias("key"))
    return puts.select("seq", F.lit("put").alias("method"), "status").unionByName(keys.select("seq", F.lit("get").alias("method"), oplog.key_status(F.col("key")).alias("status")))


@query("""
SELECT count(*) FILTER (event_type <> 'view') AS writes, count(*) FILTER (event_type = 'error') AS deletes, count(*) FILTER (event_type = 'view') AS reads,
       (SELECT count(*) FROM latest) AS keys,
       (SELECT count(*) FROM latest, instant WHERE NOT is_deleted AND NOT (expiry_ns > 0 AND now_ns > expiry_ns)) AS live_keys
FROM oplog
""")
def kv_metrics(spark, sf_dir):
    counters = table(spark, sf_dir, "events").agg(
        F.count_if(F.col("event_type") != "view").alias("writes"), F.count_if(F.col("event_type") == "error").alias("deletes"), F.count_if(F.col("event_type") == "view").alias("reads")
    )
    state = resolve.latest(events_log(spark, sf_dir)).withColumn("live", ~F.col("is_deleted") & ~resolve.expired(now(spark, sf_dir)))
    return counters.join(state.agg(F.count("*").alias("keys"), F.count_if("live").alias("live_keys")))


@query("SELECT key, value, seq FROM (SELECT 'cust:' || o_custkey AS key, o_orderpriority AS value, o_orderkey AS seq, o_orderstatus = 'F' AS is_deleted FROM orders) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND NOT is_deleted")
def kv_orders_live(spark, sf_dir):
    return resolve.live(oplog.order_log(table(spark, sf_dir, "orders")), F.lit(0)).select("key", "value", "seq")


@query("""
SELECT kind, count(*) AS n, CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) AS bytes FROM (
    SELECT 'doc' AS kind, 'doc:' || doc_id AS key, coalesce(text, '') AS value FROM documents
    UNION ALL SELECT 'page', 'page:' || page_id, coalesce(html, '') FROM pages) GROUP BY kind
""")
def kv_large_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).alias("value"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.concat(F.lit("page:"), F.col("page_id")).alias("key"), F.coalesce("html", F.lit("")).alias("value"))
    return docs.unionByName(pages).groupBy("kind").agg(F.count("*").alias("n"), F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("bytes"))


# sharding and sizes

#: FNV-1a of an ASCII key in DuckDB.
FNV_SQL = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(key, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT"


@query(f"SELECT {FNV_SQL} % 8 AS shard, seq // 100 AS batch, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM oplog GROUP BY ALL")
def shard_batch_groups(spark, sf_dir):
    log = events_log(spark, sf_dir).select((fnv1a32(F.col("key")) % SHARDS).alias("shard"), F.floor(F.col("seq") / BATCH_ROWS).alias("batch"), "seq")
    return log.groupBy("shard", "batch").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"SELECT CAST({FNV_SQL} % 32 AS INTEGER) AS shard, count(*) AS n, CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) AS bytes FROM latest GROUP BY ALL")
def memtable_shard_histogram(spark, sf_dir):
    found = resolve.latest(events_log(spark, sf_dir)).withColumn("shard", shard(F.col("key"), TABLE_SHARDS))
    return found.groupBy("shard").agg(F.count("*").alias("n"), accounting.net_bytes(found))


@query("SELECT count(*) AS n, CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) AS bytes, (SELECT CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) FROM oplog) AS written_bytes FROM latest")
def memtable_bytes(spark, sf_dir):
    log = events_log(spark, sf_dir)
    size = entry_bytes(F.col("key"), F.col("value"))
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))) == 1
    sized = log.select("key", "seq", size.alias("size")).withColumn("newest", newest)
    return sized.agg(F.count_if("newest").alias("n"), F.sum(F.when(F.col("newest"), F.col("size"))).alias("bytes"), F.sum("size").alias("written_bytes"))


@query("SELECT seq // 101 AS grp, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(strlen(key) + strlen(value) + 17) AS BIGINT) AS bytes FROM oplog GROUP BY ALL")
def group_commit_batches(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("grp", F.floor(F.col("seq") / GROUP_ROWS))
    return log.groupBy("grp").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(record_bytes(F.col("key"), F.col("value"))).alias("bytes"))


@query(LOG.replace("WITH", "WITH RECURSIVE", 1) + f"""
, sized AS (SELECT seq, key, strlen(key) + strlen(value) + 16 AS size FROM oplog),
rotated AS (
    SELECT -1::BIGINT AS "table", NULL::BIGINT AS first_seq, -1::BIGINT AS last_seq, 0::BIGINT AS n_ops, 0::BIGINT AS n_keys, 0::BIGINT AS bytes, true AS frozen
    UNION ALL
    SELECT "table", min(seq), max(seq), count(*), count(*) FILTER (fresh), CAST(max_by(net, seq) AS BIGINT), max(net) >= {FLUSH_BYTES}
    FROM (
        SELECT *, coalesce(max(net) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
        FROM (
            SELECT "table", seq, before IS NULL AS fresh, sum(size - coalesce(before, 0)) OVER (ORDER BY seq) AS net
            FROM (SELECT t."table" + 1 AS "table", s.seq, s.size, lag(s.size) OVER (PARTITION BY s.key ORDER BY s.seq) AS before FROM rotated t JOIN sized s ON s.seq > t.last_seq)
        )
    ) WHERE reached < {FLUSH_BYTES} GROUP BY "table"
)
SELECT * FROM rotated WHERE "table" >= 0
""")
def memtable_rotation(spark, sf_dir):
    return sequential.rotations(events_log(spark, sf_dir), FLUSH_BYTES)


@query(f"""
, ops AS (
    SELECT *, event_type = 'view' AS is_read, epoch_us(ts) * 1000 AS at_ns,
           last_value(CASE WHEN event_type <> 'view' THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq) AS written
    FROM oplog
), states AS (
    SELECT o.seq, o.key, o.is_read, coalesce(NOT w.is_deleted AND NOT (w.expiry_ns > 0 AND o.at_ns > w.expiry_ns), false) AS is_live
    FROM ops o LEFT JOIN oplog w ON w.seq = o.written
), folded AS (
    SELECT list_reduce(
        list_prepend({{'keys': []::VARCHAR[], 'fill': false, 'hits': 0::BIGINT, 'evictions': 0::BIGINT}}, list({{'keys': [key], 'fill': is_read AND is_live, 'hits': 0::BIGINT, 'evictions': 0::BIGINT}} ORDER BY seq)),
        lambda a, x: {{
            'keys': CASE WHEN NOT x.fill THEN list_filter(a.keys, lambda k: k <> x.keys[1])
                         WHEN list_contains(a.keys, x.keys[1]) THEN list_append(list_filter(a.keys, lambda k: k <> x.keys[1]), x.keys[1])
                         WHEN len(a.keys) >= {CACHE_KEYS} THEN list_append(a.keys[2:], x.keys[1])
                         ELSE list_append(a.keys, x.keys[1]) END,
            'fill': false,
            'hits': a.hits + CASE WHEN x.fill AND list_contains(a.keys, x.keys[1]) THEN 1 ELSE 0 END,
            'evictions': a.evictions + CASE WHEN x.fill AND NOT list_contains(a.keys, x.keys[1]) AND len(a.keys) >= {CACHE_KEYS} THEN 1 ELSE 0 END
        }}) AS f
    FROM states
)
SELECT is_read, count(*) AS ops, CASE WHEN is_read THEN f.hits ELSE 0 END AS hits, CASE WHEN is_read THEN f.evictions ELSE 0 END AS evictions FROM states, folded GROUP BY is_read, f
""")
def cache_lru_sim(spark, sf_dir):
    """Views read, all other events write; a read fills the cache with what is live at its time."""
    events = table(spark, sf_dir, "events")
    log = oplog.event_log(events, "event_type", "ts").withColumn("is_read", F.col("event_type") == "view")
    version = F.when(~F.col("is_read"), F.struct("is_deleted", "expiry_ns"))
    written = F.last(version, ignorenulls=True).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = oplog.unix_nanos(F.col("ts"))
    live = F.coalesce(~F.col("w.is_deleted") & ~((F.col("w.expiry_ns") > 0) & (at > F.col("w.expiry_ns"))), F.lit(False))
    ops = log.withColumn("w", written).select("seq", "key", "is_read", live.alias("is_live"))
    found = sequential.simulate_cache(ops, CACHE_KEYS)
    return found.groupBy("is_read").agg(F.count("*").alias("ops"), F.count_if("hit").alias("hits"), F.count("evicted").alias("evictions"))


# logs and segments


@query("SELECT seq, strlen(key) + strlen(value) + 17 AS bytes, CAST(coalesce(sum(strlen(key) + strlen(value) + 17) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM oplog")
def wal_record_bytes(spark, sf_dir):
    size = record_bytes(F.col("key"), F.col("value"))
    return accounting.running_before(events_log(spark, sf_dir), size, "seq", F.floor(F.col("seq") / BLOCK)).select("seq", size.alias("bytes"), "offset")


def _log_files(spark, sf_dir):
    return codec.encode_log(events_log(spark, sf_dir), F.floor(F.col("seq") / BLOCK))


@query("""
SELECT seq // 4096 AS file, key, value, expiry_ns, is_deleted,
       CAST(coalesce(sum(strlen(key) + strlen(value) + 17) OVER (PARTITION BY seq // 4096 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM oplog
""")
def wal_replay(spark, sf_dir):
    back = codec.decode(_log_files(spark, sf_dir), codec.read_log)
    return back.select("file", "offset", "key", F.col("value").cast("string").alias("value"), "expiry_ns", "is_deleted")


@query("""
, placed AS (
    SELECT *, seq // 4096 AS file, CAST(sum(strlen(key) + strlen(value) + 17) OVER (PARTITION BY seq // 4096 ORDER BY seq) AS BIGINT) AS upto,
           CAST(sum(strlen(key) + strlen(value) + 17) OVER (PARTITION BY seq // 4096) AS BIGINT) AS whole
    FROM oplog
)
SELECT file, key, value, expiry_ns, is_deleted FROM placed WHERE upto <= whole - 3
""")
def wal_replay_prefix(spark, sf_dir):
    torn = _log_files(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, length(content) - 3)"))
    back = codec.decode(torn, codec.read_log, lenient=True)
    return back.select("file", "key", F.col("value").cast("string").alias("value"), "expiry_ns", "is_deleted")


@query("SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY key) AS place, key, value, expiry_ns, is_deleted FROM segments")
def sst_flush(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("segment").orderBy("key")).cast("long")
    return segmented(spark, sf_dir).select("segment", place.alias("place"), "key", "value", "expiry_ns", "is_deleted")


@query("SELECT segment, key, value, expiry_ns, is_deleted FROM segments")
def sst_scan(spark, sf_dir):
    back = codec.decode(codec.encode_segments(segmented(spark, sf_dir)), codec.read_segment)
    return back.select(F.col("file").alias("segment"), "key", F.col("value").cast("string").alias("value"), "expiry_ns", "is_deleted")


@query("SELECT segment, min(key) AS min_key, max(key) AS max_key, count(*) AS n, CAST(sum(strlen(key) + strlen(value) + 17) AS BIGINT) AS bytes FROM segments GROUP BY segment")
def sst_key_range(spark, sf_dir):
    found = segmented(spark, sf_dir)
    return found.groupBy("segment").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"), F.sum(record_bytes(F.col("key"), F.col("value"))).alias("bytes"))


@query("SELECT segment, key, CAST(coalesce(sum(strlen(key) + strlen(value) + 17) OVER (PARTITION BY segment ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM segments")
def sst_offsets(spark, sf_dir):
    before = Window.partitionBy("segment").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    size = record_bytes(F.col("key"), F.col("value"))
    return segmented(spark, sf_dir).select("segment", "key", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("offset"))


@query("SELECT key, segment, value, is_deleted FROM segments WHERE key = 'user:7' QUALIFY row_number() OVER (ORDER BY segment DESC) = 1")
def sst_point_find(spark, sf_dir):
    hits = segmented(spark, sf_dir).where("key = 'user:7'")
    return hits.groupBy("key").agg(F.max_by(F.struct("segment", "value", "is_deleted"), "segment").alias("v")).select("key", "v.*")


# tiers and compaction


@query("""
SELECT key, CAST(CASE WHEN seq >= 8000 THEN 0 WHEN seq >= 4000 THEN 1 ELSE 2 END AS INTEGER) AS tier, seq,
       CASE WHEN is_deleted THEN 'deleted' WHEN expiry_ns > 0 AND now_ns > expiry_ns THEN 'expired' ELSE 'live' END AS outcome
FROM latest, instant
""")
def tier_resolve(spark, sf_dir):
    found = resolve.first_tier(tiers(spark, sf_dir))
    return found.select("key", "tier", "seq", resolve.outcome(now(spark, sf_dir)).alias("outcome"))


@query("""
SELECT level, count(*) AS n_segments, count(*) >= 4 AND level = 0 AS compact
FROM (SELECT DISTINCT segment, CAST(CASE WHEN segment = (SELECT max(segment) FROM segments) THEN -1 ELSE 0 END AS INTEGER) AS level FROM segments) GROUP BY level
""")
def compaction_plan(spark, sf_dir):
    """The last segment is still in memory, all before it are at level 0."""
    found = events_log(spark, sf_dir).select(F.floor(F.col("seq") / SEGMENT_ROWS).alias("segment")).distinct()
    last = found.agg(F.max("segment")).scalar()
    counted = found.groupBy(F.when(F.col("segment") == last, -1).otherwise(0).alias("level")).agg(F.count("*").alias("n_segments"))
    return counted.withColumn("compact", (F.col("n_segments") >= Options().compact_at) & (F.col("level") == 0))


MERGED = "SELECT *, segment // 4 AS run FROM segments QUALIFY row_number() OVER (PARTITION BY segment // 4, key ORDER BY seq DESC) = 1"


def merged_runs(spark, sf_dir):
    """All segments of level 0, merged as they come: each run of as many as start a compaction is one merge."""
    rows = segmented(spark, sf_dir).withColumn("run", F.floor(F.col("segment") / Options().compact_at))
    place = F.row_number().over(Window.partitionBy("run", "key").orderBy(F.desc("seq")))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


@query(f"SELECT run, key, value, expiry_ns, is_deleted, seq FROM ({MERGED})")
def compaction_merge(spark, sf_dir):
    return merged_runs(spark, sf_dir).select("run", "key", "value", "expiry_ns", "is_deleted", "seq")


@query(f"SELECT count(*) AS n, count(*) FILTER (is_deleted) AS tombstones, count(*) FILTER (expiry_ns > 0 AND now_ns > expiry_ns) AS expired FROM ({MERGED}), instant")
def compaction_tombstones_kept(spark, sf_dir):
    merged = merged_runs(spark, sf_dir).withColumn("late", resolve.expired(now(spark, sf_dir)))
    return merged.agg(F.count("*").alias("n"), F.count_if("is_deleted").alias("tombstones"), F.count_if("late").alias("expired"))


#: CRC-32 of an ASCII text in DuckDB: for each character one step takes it in, and eight shift.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(x, ''), lambda c: [-1 - ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda h, s: CASE WHEN s < 0 THEN xor(h, -1 - s) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384::BIGINT) ELSE h // 2 END), 4294967295::BIGINT)"""
FILTER = FilterSize.of(SEGMENT_ROWS * 10, 0.01)


@query(f"""
, names AS (
    SELECT DISTINCT segment, key, segment || ':' || key AS x FROM segments
    UNION SELECT segment, 'user:' || c_custkey, segment || ':user:' || c_custkey FROM (SELECT DISTINCT segment FROM segments), customer WHERE c_custkey IS NOT NULL
), hashed AS (SELECT segment, key, {CRC_SQL} AS h FROM names),
bits AS (
    SELECT DISTINCT segment, key, (segment % 32) * {FILTER.part_bits} + (h + i * (h >> 16)) % {FILTER.part_bits} AS bit FROM hashed, range({FILTER.probes}) r(i)
), held AS (SELECT DISTINCT segment, key FROM segments),
set_bits AS (SELECT DISTINCT segment, bit FROM bits SEMI JOIN held USING (segment, key)),
asked AS (SELECT segment, key FROM bits LEFT JOIN set_bits s USING (segment, bit) WHERE key IN (SELECT 'user:' || c_custkey FROM customer) GROUP BY segment, key HAVING count(*) = count(s.bit))
SELECT segment, count(*) AS candidates, count(h.key) AS held, count(*) - count(h.key) AS false_positives
FROM asked a LEFT JOIN held h ON a.segment = h.segment AND a.key = h.key GROUP BY a.segment
""".replace("SELECT segment, count(*) AS candidates", "SELECT a.segment, count(*) AS candidates").replace("count(s.bit)", "count(s.segment)"))
def bloom_candidates(spark, sf_dir):
    """For each segment, keys of all customers that its filter can't exclude, and how many are false."""
    rows = events_log(spark, sf_dir).select(F.floor(F.col("seq") / SEGMENT_ROWS).alias("segment"), "key")
    keys = table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL").select(F.concat(F.lit("user:"), F.col("c_custkey")).alias("key"))
    found = membership.candidates(rows, keys, FILTER)
    return found.withColumn("false_positives", F.col("candidates") - F.col("held"))


@query("SELECT key, value, expiry_ns, is_deleted, seq FROM latest")
def store_state(spark, sf_dir):
    """The same log through a store: appended in three parts, flushed twice, compacted, reopened, read."""
    folder = upsert.scratch(spark, "store")
    store = Store(spark, folder, Options(compact_at=2))
    for i, part in enumerate(reversed(tiers(spark, sf_dir))):
        # each append numbers its rows after those before
        first = store.manifest.next_seq
        store.append(part.withColumn("seq", F.col("seq") - F.lit(first)))
        if i < 2:
            store.flush()
    store.compact()
    return Store(spark, folder).state().select("key", "value", "expiry_ns", "is_deleted", "seq")


@query("SELECT key, value, expiry_ns, is_deleted, seq FROM latest")
def stream_upsert(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    folder_of = path if _is_folder(spark, path) else sf_dir
    stream = (reader if folder_of == path else reader.option("pathGlobFilter", "events.parquet")).parquet(folder_of)
    folder = upsert.scratch(spark, "upsert")
    upsert.run_upsert(oplog.event_log(stream), f"{folder}/out", f"{folder}/checkpoint")
    return upsert.read_upsert(spark, f"{folder}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("""
WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT max(n) AS n, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean,
       (max(CASE WHEN place = (n - 1) // 2 THEN x END) + max(CASE WHEN place = n // 2 THEN x END)) / 2 AS median,
       max(CASE WHEN place = CASE WHEN n > 20 THEN CAST(floor(n * 0.95::DOUBLE) AS BIGINT) ELSE n - 1 END THEN x END) AS p95,
       max(CASE WHEN place = CASE WHEN n > 100 THEN CAST(floor(n * 0.99::DOUBLE) AS BIGINT) ELSE n - 1 END THEN x END) AS p99
FROM s
""")
def bench_latency_stats(spark, sf_dir):
    return accounting.sample_statistics(table(spark, sf_dir, "events"), "value")
