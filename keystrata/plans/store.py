"""A store of versioned keys: Parquet segments under a durable manifest.

``put`` and ``append`` write a segment of new versions to memory level (-1); ``flush`` sorts what has been appended into
one segment of level 0; ``compact`` merges all of level 0, once there are enough, into level 1. Merged segments are
range-partitioned and sorted by key, so Parquet's statistics prune point reads.

A commit writes the next numbered manifest under a name of its own and renames it, which fails if that number is there
already; the newest number is the store. So readers pin one version and never see half a change, a crash between two
steps leaves the version before, and of two writers one wins: the other reads what was committed and tries again, with
sequence numbers after it. (Object stores without a rename need a committer that refuses to overwrite.)

The manifest is small (a line a segment) and is read and written by the driver through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import resolve
from keystrata.operators.sequential import RecentKeys

SCHEMA = "key string, value string, expiry_ns long, is_deleted boolean, seq long"
MEMORY, FIRST, MERGED = -1, 0, 1
MANIFEST = re.compile(r"manifest-(\d+)\.json")


@dataclass(frozen=True)
class Options:
    flush_bytes: int = 64 << 20
    compact_at: int = 4
    bloom_rate: float = 0.01
    cache_keys: int = 40_000

    @classmethod
    def of(cls, settings: dict) -> Options:
        """Defaults overlaid with the settings that are given, under their own names or those of a configuration file."""
        named = {SETTINGS.get(k, k): v for k, v in settings.items()}
        return cls(**{k: v for k, v in named.items() if k in cls.__dataclass_fields__})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Options:
        """From a JSON file in any file system that Spark reads; settings that it lacks have their defaults."""
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        try:
            settings = json.loads(text)
        except ValueError as e:
            raise ValueError(f"{path} is no JSON: {e}") from None
        return cls.of(settings)


# The names of these settings in a configuration file.
SETTINGS = {
    "maximum_memtable_size_in_bytes": "flush_bytes",
    "level_zero_compaction_trigger_count": "compact_at",
    "bloom_filter_false_positive_rate": "bloom_rate",
    "key_cache_capacity_count": "cache_keys",
}


@dataclass(frozen=True)
class Segment:
    segment_id: int
    level: int
    path: str
    rows: int
    bytes: int
    min_key: str | None
    max_key: str | None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 0
    next_segment: int = 0
    segments: tuple[Segment, ...] = field(default_factory=tuple)

    def at(self, level: int) -> list[Segment]:
        return [s for s in self.segments if s.level == level]


class Store:
    def __init__(self, spark: SparkSession, folder: str, options: Options = Options()):  # noqa: B008  frozen
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.manifest = self._load()
        self.counters = dict.fromkeys(("writes", "reads", "cache_hits", "found", "missing"), 0)
        self._recent, self._recent_of = RecentKeys(self.options.cache_keys), self.manifest.version

    # files

    def _fs(self, path: str):
        at = self._hadoop.Path(path)
        return at.getFileSystem(self._conf), at

    def _read(self, path: str) -> str | None:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _load(self) -> Manifest:
        fs, top = self._fs(self.folder)
        if not fs.exists(top):
            return Manifest()
        names = (f.getPath().getName() for f in fs.listStatus(top) if f.isFile())
        numbers = [int(m[1]) for m in map(MANIFEST.fullmatch, names) if m]
        if not numbers:
            return Manifest()
        raw = json.loads(self._read(f"{self.folder}/manifest-{max(numbers)}.json"))
        return Manifest(raw["version"], raw["next_seq"], raw["next_segment"], tuple(Segment(**s) for s in raw["segments"]))

    def _commit(self, manifest: Manifest) -> bool:
        """Whether ``manifest`` became the next version; not if another writer's did."""
        fs, new = self._fs(f"{self.folder}/_manifest.{uuid.uuid4().hex}")
        stream = fs.create(new, False)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(self._hadoop.Options.Rename, 0)
        to = self._hadoop.Path(f"{self.folder}/manifest-{manifest.version}.json")
        context = self._hadoop.FileContext.getFileContext(new.toUri(), self._conf)
        try:
            context.rename(new, to, plain)
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.manifest = self._load()
            return False
        self.manifest = manifest
        return True

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _segment(self, rows: DataFrame, level: int, number: int) -> tuple[Segment, int | None]:
        """The written segment, and its highest sequence number; both are observed while it is written."""
        path = f"{self.folder}/L{max(level, 0)}_{number}-{uuid.uuid4().hex}"
        ordered = rows if level == MEMORY else rows.repartitionByRange("key").sortWithinPartitions("key", "seq")
        size = F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value") + 16), F.lit(0)).cast("long")
        seen = Observation()
        written = ordered.observe(seen, F.count("*").alias("n"), size.alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("seq").alias("last"))
        written.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.bloom_rate)).option("parquet.enable.dictionary#key", "false").parquet(path)
        got = seen.get
        return Segment(number, level, path, got["n"], got["size"], got["low"], got["high"]), got["last"]

    # writes

    def append(self, rows: DataFrame, order: Column | None = None) -> Manifest:
        """Adds versions (key, value, expiry_ns, is_deleted); later ones in ``order`` are newer.

        A ``seq`` column of the rows is kept as the order inside the append; else ``order`` gives it. Sequence numbers of
        an append follow all before.
        """
        rows = rows if order is None else rows.withColumn("seq", order)
        while True:
            now = self.manifest
            inside = rows.select("key", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), "expiry_ns", "is_deleted", (F.col("seq") + F.lit(now.next_seq)).alias("seq"))
            made, last = self._segment(inside, MEMORY, now.next_segment)
            if self._commit(Manifest(now.version + 1, now.next_seq if last is None else last + 1, now.next_segment + 1, (*now.segments, made))):
                break
            self._delete(made.path)
        self.counters["writes"] += made.rows
        if sum(s.bytes for s in self.manifest.at(MEMORY)) >= self.options.flush_bytes:
            self.flush()
        return self.manifest

    def put(self, key: str, value: str, ttl: int = 0, now_ns: int = 0) -> Manifest:
        row = [(key, value, now_ns + ttl * resolve.NANOS if ttl > 0 else 0, False, 0)]
        return self.append(self.spark.createDataFrame(row, SCHEMA))

    def put_batch(self, items: list[dict], now_ns: int = 0) -> Manifest:
        """Items with key and, if wanted, value and ttl, in one commit: all or none; a later item of a key wins."""
        rows = [(x["key"], x.get("value") or "", now_ns + ttl * resolve.NANOS if (ttl := x.get("ttl") or 0) > 0 else 0, False, i) for i, x in enumerate(items)]
        return self.append(self.spark.createDataFrame(rows, SCHEMA)) if rows else self.manifest

    def delete(self, key: str) -> Manifest:
        return self.append(self.spark.createDataFrame([(key, "", 0, True, 0)], SCHEMA))

    def flush(self) -> Manifest:
        """Memory becomes one sorted segment of level 0, a row a key."""
        return self._merge(MEMORY, FIRST, None)

    def compact(self, force: bool = False, purge_at_ns: int | None = None) -> Manifest:
        """Merges all of level 0 into a segment of level 1 once there are enough of them. Deleted and expired versions
        stay, for they hide older ones; ``purge_at_ns`` merges level 1 as well and drops them."""
        if len(self.manifest.at(FIRST)) < (1 if force else self.options.compact_at):
            return self.manifest
        return self._merge(FIRST, MERGED, purge_at_ns)

    def _merge(self, source: int, target: int, purge_at_ns: int | None) -> Manifest:
        now = self.manifest
        taken = now.at(source) + (now.at(target) if purge_at_ns is not None else [])
        if not taken:
            return now
        merged = resolve.latest(self._scan(taken))
        if purge_at_ns is not None:
            merged = merged.where(~F.col("is_deleted") & ~resolve.expired(F.lit(purge_at_ns)))
        made, _ = self._segment(merged, target, now.next_segment)
        return self._publish(made, taken)

    def _publish(self, made: Segment, taken: list[Segment]) -> Manifest:
        """A merged segment in place of those it was made from, beside what other writers have committed meanwhile. If one
        of those is gone, another writer has merged it, and the merge is dropped."""
        while set(taken) <= set(self.manifest.segments):
            now = self.manifest
            own = Segment(now.next_segment, made.level, made.path, made.rows, made.bytes, made.min_key, made.max_key)
            if self._commit(Manifest(now.version + 1, now.next_seq, now.next_segment + 1, (*(s for s in now.segments if s not in taken), own))):
                return self.manifest
        self._delete(made.path)
        return self.manifest

    def vacuum(self) -> list[str]:
        """Deletes segments that the newest manifest doesn't name; no reader may hold an older one, and no writer may be
        at work."""
        fs, top = self._fs(self.folder)
        self.manifest = self._load()
        named = {s.path.rsplit("/", 1)[1] for s in self.manifest.segments}
        gone = [f.getPath() for f in fs.listStatus(top) if f.isDirectory() and f.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return [p.getName() for p in gone]

    # reads

    def _scan(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(s.path for s in segments))

    def log(self, manifest: Manifest | None = None) -> DataFrame:
        """All versions of one manifest's segments."""
        return self._scan(list((manifest or self.manifest).segments))

    def state(self, manifest: Manifest | None = None) -> DataFrame:
        """The newest version of each key. Tiers need no order: sequence numbers say which version is newest."""
        return resolve.latest(self.log(manifest))

    def get(self, key: str, now_ns: int) -> str | None:
        """The live value of a key. Segments whose key range excludes it aren't opened; versions read are kept for the
        next read until the manifest changes, with their expiry, which is applied on every read."""
        if self._recent_of != self.manifest.version:
            self._recent, self._recent_of = RecentKeys(self.options.cache_keys), self.manifest.version
        self.counters["reads"] += 1
        version = self._recent.get(key)
        if version is not None:
            self.counters["cache_hits"] += 1
        else:
            near = [s for s in self.manifest.segments if s.rows and s.min_key <= key <= s.max_key]
            row = resolve.latest(self._scan(near).where(F.col("key") == key)).first()
            version = (None, 0, True) if row is None else (row["value"], row["expiry_ns"], row["is_deleted"])
            self._recent.put(key, version)
        value, expiry_ns, deleted = version
        gone = deleted or 0 < expiry_ns < now_ns
        self.counters["missing" if gone else "found"] += 1
        return None if gone else value

    def get_many(self, keys: DataFrame, now_ns: int) -> DataFrame:
        """Each key of a table with its outcome, and its value where live."""
        return resolve.lookup(keys, self.log(), F.lit(now_ns))

    def metrics(self) -> dict[str, int]:
        """Counters of this handle, and rows, bytes and segments of the manifest."""
        levels = {f"segments_at_{name}": len(self.manifest.at(level)) for name, level in (("memory", MEMORY), ("first", FIRST), ("merged", MERGED))}
        return self.counters | levels | {"rows": sum(s.rows for s in self.manifest.segments), "bytes": sum(s.bytes for s in self.manifest.segments)}
