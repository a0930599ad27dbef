"""SimHash near-duplicates through Golay-code fuzzy keys.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints are brought
together first, so exact copies, however many, count once. Each distinct fingerprint gets its fuzzy keys (see
``golay``); rows with one key meet in sorted order, and a task compares them block by block in arrays: it emits the
links of a spanning forest of each key's rows, never all pairs, so a large group of near copies costs a few links a
member. Links make components by distributed star contraction.

Scale: keys hold 24 bits, so rows a key stay few until there are very many distinct fingerprints, and what grows then is
comparisons of 64-bit numbers in arrays, not rows. A task holds 16 bytes a row of the key it is at. Nothing is
broadcast or collected; tables between steps go to the shared folder.

Defined results of the query: null text and text without words have fingerprint zero; a null id is never the smallest
(a component of null ids only has a null component_id); repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_slices
from .components import components
from .golay import keys

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of one key up to which all are compared at once; seed of the shingles' hashes.
SMALL_RUN, SEED = 32, 42


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(text: str | None, size: int) -> list[bytes]:
    """All runs of ``size`` words; of fewer words, the whole; of none, nothing."""
    w = words(text)
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(size)), strict=False)]


def hashes(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of all texts in a row, and how many each text has."""
    from xxhash import xxh64_intdigest

    found = [[xxh64_intdigest(s, SEED) for s in shingles(t, size)] for t in texts]
    flat = np.fromiter((h for f in found for h in f), dtype=np.uint64, count=sum(map(len, found)))
    return flat, np.array([len(f) for f in found], dtype=np.int64)


def fingerprints(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority of each bit over each text's hashes."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.nonzero(counts)[0]
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    for bit in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
        out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row a document, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, chars=2_000_000):
            fp = fingerprints(*hashes(piece.column("text").to_pylist(), size))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that connect all rows connected by steps of at most ``radius`` bits: one less than the rows of
    each connected part. The search starts at the row nearest the majority and leaves rows once they are reached."""
    majority = fingerprints(fp, np.array([len(fp)]))[0]
    rest = np.argsort(np.bitwise_count(fp ^ majority), kind="stable")
    left, right = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop(0)
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= radius
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found.tolist())
                rest = rest[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links_of_runs(key: np.ndarray, fp: np.ndarray, radius: int, all_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (rows are sorted by key). Short runs are compared by shifted arrays.

    ``all_pairs``: short runs give all their links, else links are cut to a forest where a run has many.
    """
    edges = np.nonzero(np.diff(key))[0] + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
    length = ends - starts
    left, right = [], []
    short = (length >= 2) & (length <= SMALL_RUN)
    if short.any():
        rows = np.repeat(starts[short], length[short]) + _ramp(length[short])
        end = np.repeat(ends[short], length[short])
        for step in range(1, int(length[short].max())):
            some = rows + step < end
            rows, end = rows[some], end[some]
            near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius
            left.append(rows[near])
            right.append(rows[near] + step)
    for s, e in zip(starts[length > SMALL_RUN], ends[length > SMALL_RUN], strict=True):
        a, b = forest(fp[s:e], radius)
        left.append(a + s)
        right.append(b + s)
    if not left:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    a, b = np.concatenate(left), np.concatenate(right)
    if not all_pairs and len(a):
        a, b = _thinned(a, b, np.repeat(np.arange(len(starts)), length), length)
    return a, b


def _ramp(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _thinned(a: np.ndarray, b: np.ndarray, run: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a run has as many links as rows or more, only links that join parts not yet joined are kept."""
    many = np.bincount(run[a], minlength=len(length)) >= length
    keep = ~many[run[a]]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for i in np.nonzero(~keep)[0]:
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            parent[x] = y
            keep[i] = True
    return a[keep], b[keep]


def fuzzy_links(nodes: DataFrame, radius: int, all_pairs: bool = False) -> DataFrame:
    """(a, b) with a < b: links between nodes (node, fp; both longs, nodes distinct) at most ``radius`` bits apart.

    Up to three bits, all such nodes end up connected (see ``golay``); beyond, most of those up to eight bits do.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                node, fp = batch.column("node").to_numpy(), batch.column("fp").to_numpy()
                key, row = keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(fp[row])], names=["key", "node", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = links_of_runs(key, fp.view(np.uint64), radius, all_pairs)
            pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy() for c in ("key", "node", "fp"))
            held.append(now)
            if held[0][0][-1] == now[0][-1] and now[0][0] == now[0][-1]:
                continue  # the run goes on
            joined = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(joined[0], joined[0][-1]))
            if cut:
                yield out(*(c[:cut] for c in joined))
            held = [tuple(c[cut:] for c in joined)]
        if held:
            yield out(*(np.concatenate(c) for c in zip(*held, strict=True)))

    spread_rows = nodes.select("node", "fp").mapInArrow(spread, "key int, node long, fp long")
    sorted_rows = spread_rows.repartition("key").sortWithinPartitions("key", "fp", "node")
    return sorted_rows.mapInArrow(meet, "a long, b long").distinct()


def linked_components(prints: DataFrame, radius: int) -> DataFrame:
    """(doc_id, fp, component_id) for each row of (doc_id, fp): fingerprints within ``radius`` bits are linked."""
    prints = materialize(prints, "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = fuzzy_links(firsts.select(F.col("fp").alias("node"), "fp"), radius)
    roots = components(links, "a", "b", "fingerprint-links")
    placed = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = placed.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return prints.join(of, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def hexadecimal(column: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_components(with_fingerprint(table(spark, sf_dir, "documents"), 3), 3)
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")
