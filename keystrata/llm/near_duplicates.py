"""Near-duplicate groups of documents: SimHash fuzzy keys and minima of word shingles, verified by word shingles.

Documents with the same words are brought together first, by 128 bits of digests. Each distinct text has a SimHash of
its two-word shingles, whose Golay fuzzy keys (see ``golay``) bring those within ``RADIUS`` bits together, and ``BANDS``
keys, each of the minima of ``ROWS`` hashes over its five-word shingles: texts with a Jaccard similarity of s share one of
these with a probability of 1 - (1 - s**ROWS)**BANDS, which is above 0.9999 for ``SIMILARITY`` and more, wherever they
differ. Eight bits of each minimum are a sketch; the share of equal ones estimates the similarity to 0.04. Texts that
share a key and whose sketches say ``LIKELY`` or more are candidates. A candidate is a link if the whole sets of five-word
shingles have the similarity. Linked texts make groups.

Candidates are tried in two rounds, so that a group of many near copies costs a few links a member and no link between
different groups stays untried. First each text with the likeliest first text of its keys, and the links of the fuzzy
keys' forest. Then, in keys whose texts aren't all in one group yet, every text with all likely texts of other groups,
the likeliest first: a task holds a key's texts as sketches and sets, compares them in arrays, and emits a link only
where it joins two groups, so less than one a text. Nothing is broadcast or collected.

Defined results: null text and text without words are one text (they are copies of each other); documents with a null
id count as one per text; of a group the document with the smallest id stays, of repeated rows of it one; an empty
table gives no rows; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, text_slices
from .components import components
from .digests import byte_words, digest
from .simhash import fingerprints, fuzzy_links

RADIUS, FEATURE_WORDS, SHINGLE_WORDS, SIMILARITY, LIKELY = 8, 2, 5, 0.8, 0.7
#: Keys of a text and the minima in each; the factors and summands of their hashes, the same in every run.
BANDS, ROWS = 24, 5
_DRAWN = np.random.default_rng(21).integers(0, 2**32, (2, BANDS * ROWS), dtype=np.uint32)
FACTORS, SUMMANDS = _DRAWN[0] | np.uint32(1), _DRAWN[1]

def shingles(name: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all runs of ``size`` words of each text, and how many it has; of fewer words, the whole; of none, none."""
    starts = np.cumsum(counts) - counts
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), runs)
    first = starts[doc] + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    out = digest(np.minimum(counts, size)[doc].astype(np.uint64), np.full(len(doc), 7, dtype=np.uint64))
    for i in range(size):
        there = counts[doc] > i
        out = np.where(there, digest(name[np.minimum(first + i, max(0, len(name) - 1))], out), out) if len(name) else out
    return out, runs


def text_names(name: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit names of each text's words, a row each."""
    ends = np.cumsum(counts)
    up = np.cumprod(np.full(int(counts.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    place = np.arange(len(name)) - np.repeat(ends - counts, counts)
    out = []
    for seed in (1, 2):
        sums = np.append(np.uint64(0), np.cumsum(digest(name, np.full(len(name), seed, dtype=np.uint64)) * up[place]))
        out.append(digest(sums[ends] - sums[ends - counts], counts.astype(np.uint64)))
    return np.stack(out).view(np.int64)


def minima(flat: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """A row of ``BANDS * ROWS`` minima for each text; of nothing, zeros."""
    low = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(runs), len(FACTORS)), dtype=np.uint32)
    ends = np.cumsum(runs)
    for i, (end, n) in enumerate(zip(ends.tolist(), runs.tolist(), strict=True)):
        for at in range(end - n, end, 8192):
            least = (low[None, at : min(end, at + 8192)] * FACTORS[:, None] + SUMMANDS[:, None]).min(1)
            out[i] = least if at == end - n else np.minimum(out[i], least)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each row of minima."""
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(least), axis=0)
    for row in range(ROWS):
        keys = digest(least[:, row::ROWS].astype(np.uint64), keys)
    return keys.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bytes of sketches, row by row (of two blocks, for all pairs)."""
    return np.count_nonzero(a == b, axis=-1) / (BANDS * ROWS)


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def row_keys(docs: DataFrame) -> list[Column]:
    """What tells a document: its id, and two digests of its text; the first stands for a null id."""
    text = docs["text"]
    one, two = (F.xxhash64(F.lit(i), text.isNull(), text) for i in (1, 2))
    return [F.coalesce(docs["doc_id"].cast("long"), one), one, two]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, fp, id, one, two, keys, sketch): a numbered row for each distinct text, with its first document's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, chars=2_000_000):
            name, counts = byte_words(piece.column("text").to_pylist())
            least = minima(*shingles(name, counts, SHINGLE_WORDS))
            fp = fingerprints(*shingles(name, counts, FEATURE_WORDS)).view(np.int64)
            high, low = text_names(name, counts)
            columns = [pa.array(high), pa.array(low), *(piece.column(c) for c in ("id", "one", "two")), pa.array(fp), pa.array(list(band_keys(least)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in least.astype(np.uint8)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "id", "one", "two", "fp", "keys", "sketch"])

    one = docs.select(*(c.alias(n) for c, n in zip(row_keys(docs), ("id", "one", "two"), strict=True)), "text")
    rows = one.mapInArrow(run, "high long, low long, id long, one long, two long, fp long, keys array<long>, sketch binary")
    firsts = rows.groupBy("high", "low").agg(F.min(F.struct("id", "one", "two", "fp", "keys", "sketch")).alias("f"))
    return materialize(firsts.select("f.*").withColumn("node", F.monotonically_increasing_id()), "texts")


def likely(links: DataFrame, nodes: DataFrame, least: float = LIKELY) -> DataFrame:
    """(a, b, like) of the links whose sketches are alike."""
    side = lambda n: nodes.select(F.col("node").alias(f"n{n}"), F.col("sketch").alias(f"s{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                piece = whole.slice(at, 4096)
                like = alike(sketches(piece.column("sa")), sketches(piece.column("sb")))
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(like)], names=["a", "b", "like"]).filter(pa.array(like >= least))

    both = links.join(side("b"), F.col("b") == F.col("nb")).join(side("a"), F.col("a") == F.col("na"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, like double")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, hub) for the keys of more than one text; the hub is its first."""
    spread = nodes.select("node", F.explode("keys").alias("key"))
    many = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").select(F.col("key").alias("k"), "hub")
    return materialize(spread.join(many, F.col("key") == F.col("k")).select("key", "node", "hub"), "text-keys")


def first_links(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b): the links of the fuzzy keys' forest, and each text with the likeliest first text of its keys."""
    stars = shared.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    best = likely(stars, nodes).groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a")).select("a", "b")
    fuzzy = likely(fuzzy_links(nodes.select("node", "fp"), RADIUS), nodes).select("a", "b")
    return best.unionByName(fuzzy).distinct()


def shingle_sets(texts: list[str | None]) -> list[bytes]:
    """Each text's shingles as sorted distinct 32-bit hashes."""
    flat, runs = shingles(*byte_words(texts), SHINGLE_WORDS)
    low, ends = (flat >> np.uint64(32)).astype(np.uint32), np.cumsum(runs)
    return [np.unique(low[e - n : e]).tobytes() for e, n in zip(ends.tolist(), runs.tolist(), strict=True)]


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) for the distinct texts in ``wanted`` (node), written."""
    wanted = nodes.join(wanted.select(F.col("node").alias("n")), F.col("node") == F.col("n")).select("node", *(F.col(c).alias(f"w_{c}") for c in ("id", "one", "two")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, chars=2_000_000):
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(shingle_sets(piece.column("text").to_pylist()), pa.binary())], names=["node", "set"])

    rows = docs.select(*(c.alias(n) for c, n in zip(row_keys(docs), ("id", "one", "two"), strict=True)), "text")
    texts = rows.join(wanted.hint("merge"), (F.col("id") == F.col("w_id")) & (F.col("one") == F.col("w_one")) & (F.col("two") == F.col("w_two"))).select("node", "text")
    return materialize(texts.mapInArrow(run, "node long, set binary").groupBy("node").agg(F.min("set").alias("set")), "shingle-sets")


def verified(docs: DataFrame, nodes: DataFrame, links: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The links whose texts are similar enough, written."""
    found = sets_of(docs, nodes, links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct())
    left = found.select(F.col("node").alias("na"), F.col("set").alias("sa"))
    right = found.select(F.col("node").alias("nb"), F.col("set").alias("sb"))
    pairs = links.join(right, F.col("b") == F.col("nb")).join(left, F.col("a") == F.col("na")).select("a", "b", "sa", "sb")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                piece = whole.slice(at, 512)
                like = [similarity(x, y) >= least for x, y in zip(piece.column("sa").to_pylist(), piece.column("sb").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], names=["a", "b"]).filter(pa.array(like, pa.bool_()))

    good = materialize(pairs.mapInArrow(judge, "a long, b long"), "text-links")
    forget(found)
    return good


def joining(root: np.ndarray, node: np.ndarray, sketch: np.ndarray, sets: list[bytes], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join groups (``root``) of one key's texts: all that are connected by likely and similar pairs end up so."""
    group = np.unique(root, return_inverse=True)[1]
    out = []
    # every pair of groups has one that isn't the largest
    for i in np.nonzero(group != np.bincount(group).argmax())[0].tolist():
        other = np.nonzero(group != group[i])[0]
        like = alike(sketch[i], sketch[other])
        near = like >= LIKELY
        for j in other[near][np.argsort(-like[near], kind="stable")].tolist():
            if group[j] != group[i] and similarity(sets[i], sets[j]) >= least:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                group[group == group[j]] = group[i]
    return out


def further_links(docs: DataFrame, shared: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): verified links that join groups, from the keys whose texts are of several."""
    rooted = roots.withColumnRenamed("node", "n")
    placed = shared.join(rooted, F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("key").alias("k"))
    rows = materialize(placed.join(open_, F.col("key") == F.col("k")).select("key", "root", "node"), "text-keys")
    found = sets_of(docs, nodes, rows.select("node").distinct())
    full = found.join(nodes.select(F.col("node").alias("n"), "sketch"), F.col("node") == F.col("n")).select("n", "sketch", "set")
    full = rows.join(full, F.col("node") == F.col("n")).select("key", "root", "node", "sketch", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            key, root, node = (whole.column(c).to_numpy() for c in ("key", "root", "node"))
            edges = np.append(np.nonzero(np.diff(key, prepend=key[0] - 1))[0], len(key))
            links = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if root[lo] != root[hi - 1]:
                    part = whole.slice(lo, hi - lo)
                    links += joining(root[lo:hi], node[lo:hi], sketches(part.column("sketch")), part.column("set").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                key = batch.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if held and (cut or held[-1].column("key")[-1].as_py() != key[0]):
                    held.append(batch.slice(0, cut))
                    yield out()
                    held = []
                elif cut:
                    held = [batch.slice(0, cut)]
                    yield out()
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield out()

    links = full.repartition("key").sortWithinPartitions("key", "root", "node").mapInArrow(run, "a long, b long").distinct()
    links = materialize(links, "text-links")
    forget(rows)
    forget(found)
    return links


def groups(docs: DataFrame) -> DataFrame:
    """(id, one, two): the keys of the document that stays, for each group."""
    nodes = distinct_texts(docs)
    shared = shared_keys(nodes)
    tried = materialize(first_links(nodes, shared), "text-candidates")
    good = verified(docs, nodes, tried)
    roots = materialize(components(good, "a", "b", "text-links"), "text-roots")
    good = good.unionByName(further_links(docs, shared, nodes, roots))
    roots = materialize(components(good, "a", "b", "text-links"), "text-roots")
    placed = nodes.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("id", "one", "two", F.coalesce("root", "node").alias("root"))
    kept = materialize(placed.groupBy("root").agg(F.min(F.struct("id", "one", "two")).alias("k")).select("k.*"), "text-keepers")
    for done in (nodes, shared, tried, good, roots):
        forget(done)
    return kept


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns as they are."""
    kept = groups(docs)
    keys = row_keys(docs)
    own = [f"_{i}_{'_'.join(docs.columns)}" for i in range(3)]  # names that no column has
    rows = docs.select("*", *(k.alias(n) for k, n in zip(keys, own, strict=True)))
    at = [rows[n] == kept[c] for n, c in zip(own, ("id", "one", "two"), strict=True)]
    return rows.join(kept.hint("merge"), at[0] & at[1] & at[2], "left_semi").dropDuplicates(own).select(*docs.columns)
