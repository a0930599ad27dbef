"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors become integers floor(256 x). Pivots are rows chosen by a digest of their id (a bounded number, the only fitted
part), each of another id. Every vector, query or not, goes to its nearest pivot's cell. A cell's summary is its count
and the largest distance of a member, and of a query, from the pivot. Queries are first solved in their own cell; the
k-th best score there, or against the pivots, which are rows themselves, is a lower bound of the k-th best of all. By the
summaries, no score between a query within R of pivot p and a member within r of pivot p' is above p.p' + R |p'| +
(|p| + R) r; cells that this excludes for all queries of a cell are dropped for the group. Of the rest a query is sent
only to those whose own bound, the lesser of q.p' + |q| r and |q| (|p'| + r), reaches its floor.

A cell's data are cut into blocks. A task holds one block and streams the queries that were sent to it past it, in matrix
products; so data is moved once, whatever the number of queries. The best k of each block meet in a ranking by query.

Exact in any geometry: where the bounds can't exclude a cell, it is searched. Cells of any size are cut into blocks, so a
cell with a third of all rows is many tasks' work. Broadcast: the pivots and the summaries, ``pivots`` rows at most.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part; a shorter vector counts
as padded with zeros (an empty one as all zeros); a query without candidates gives no rows; the query's own row is told
by its id, so repeated rows of one id are never each other's candidates and repeated candidates of one id count once,
with their best score; null ids take no part; ties go to the smaller id; other columns are not read. Scores
must fit a long, or the query raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Rows of a block of data that one task holds; pivots, and so cells, at most.
DATA_BLOCK, PIVOTS = 16384, 64


def quantize(vec: Column) -> Column:
    """floor(256 x) of each component, x as double; null if the vector takes no part."""
    doubles = vec.cast("array<double>")
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(doubles, lambda x: F.floor(x * 256.0).cast("double")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, cols] = flat
    return out


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while they are exact, else in longs; raises where a long is too small."""
    bound = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if bound < 2**53:
        return (queries @ data.T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("inner products don't fit a long")
    return queries.astype(np.int64) @ data.astype(np.int64).T


def _pivots(vectors: DataFrame, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and a vector of each, those with the smallest digests: a bounded sample, the same in every run."""
    ids = [r["vec_id"] for r in vectors.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    rows = vectors.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    dim = max((len(r["v"]) for r in rows), default=0)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r["v"])] = r["v"]
    return np.array([r["vec_id"] for r in rows], dtype=np.int64), out


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """query, vec_id, score: for each query its k best ids among the rows, or more where an id has several rows."""
    out = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
    for at in range(0, len(q), 256):
        s = scores(q[at : at + 256], x)
        s = np.where(q_ids[at : at + 256, None] == ids[None, :], np.iinfo(np.int64).min, s)
        for i, row in enumerate(s):
            # repeated ids may take several places, so a few more are kept until the ids differ
            take = min(k, len(row))
            while True:
                edge = np.partition(row, len(row) - take)[len(row) - take]
                best = np.concatenate([np.nonzero(row > edge)[0], np.nonzero(row == edge)[0][:take]])
                if take == len(row) or len(np.unique(ids[best])) >= k:
                    break
                take = min(len(row), 2 * take)
            best = best[row[best] > np.iinfo(np.int64).min]
            for to, v in zip(out, (np.full(len(best), q_ids[at + i]), ids[best], row[best]), strict=True):
                to.append(v)
    return [np.concatenate(v) for v in out]


def meet(data: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block of ``data`` (cell, block, vec_id, v) for the ``queries`` sent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, x, ids = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "kind")], axis=1)
            edges = np.nonzero((np.diff(keys, axis=0, prepend=keys[:1] - 1) != 0).any(1))[0]
            for lo, hi in zip(edges, np.append(edges[1:], len(keys)), strict=True):
                cell, block, kind = keys[lo].tolist()
                v, own = matrix(batch.column("v").slice(lo, hi - lo), dim), batch.column("vec_id").slice(lo, hi - lo).to_numpy()
                if (cell, block) != of:
                    of, held, x = (cell, block), [], None
                if kind == 0:
                    held.append((own, v))
                    continue
                if x is None and held:
                    ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    order, held = np.argsort(ids, kind="stable"), []
                    ids, x = ids[order], x[order]
                if x is not None:
                    found = best_of(v, own, x, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    columns = ["cell", "block", "kind", "vec_id", "v"]
    both = data.withColumn("kind", F.lit(0)).select(columns).unionByName(queries.withColumn("kind", F.lit(1)).select(columns))
    return both.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with an id once, at its best score, and its rank."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, data_block: int = DATA_BLOCK, tally: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner products for each row where ``is_query``.

    ``tally`` gets the numbers of pairs of a group of queries and a cell, and of a query and a cell, that there are and
    that are searched.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantize(F.col(vec_col)).alias("v"), is_query.alias("q"))
    own = own.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    pivot_ids, centers = _pivots(own, pivots)
    if not len(pivot_ids):
        return own.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    dim = own.agg(F.max(F.size("v"))).first()[0]
    centers = np.pad(centers, ((0, 0), (0, dim - centers.shape[1])))
    lengths = np.sqrt((centers**2).sum(1))

    def known(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The k-th best score against the pivots."""
        at_pivots = np.where(ids[:, None] == pivot_ids[None, :], -np.inf, x @ centers.T)
        return np.sort(at_pivots, axis=1)[:, -k] if len(pivot_ids) >= k else np.full(len(x), -np.inf)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix(batch.column("v"), dim)
                cell = np.argmax(x @ centers.T - lengths**2 / 2, axis=1)
                far = np.sqrt(((x - centers[cell]) ** 2).sum(1))
                floor = known(x, np.asarray(batch.column("vec_id")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "q")), pa.array(cell, pa.int32()), pa.array(far), pa.array(floor)], names=["vec_id", "v", "q", "cell", "far", "floor"])

    celled = materialize(own.mapInArrow(assign, "vec_id long, v array<double>, q boolean, cell int, far double, floor double"), "cells")
    sums = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.count_if("q").alias("m"), F.max(F.when(F.col("q"), F.col("far"))).alias("rq")).orderBy("cell").collect()
    cells = np.array([r["cell"] for r in sums], dtype=np.int64)
    radius, reach = np.array([r["r"] for r in sums]), np.array([r["rq"] if r["m"] else -np.inf for r in sums])
    blocks = {r["cell"]: -(-r["n"] // data_block) for r in sums}
    n_blocks = F.element_at(F.create_map(*(F.lit(x) for c, n in blocks.items() for x in (c, n))), F.col("cell"))
    data = celled.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), n_blocks).cast("int"))
    queries = celled.where("q").select("vec_id", "v", "cell", "floor")
    every_block = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    near = materialize(meet(data, queries.withColumn("block", every_block), dim, k), "own-cells")

    floors = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("own"))
    asked = queries.join(floors.groupBy("of").agg(F.max("own").alias("own")), F.col("vec_id") == F.col("of"), "left")
    asked = materialize(asked.select("vec_id", "v", "cell", F.greatest("floor", "own").alias("floor")), "queries")
    least = {r["cell"]: r["f"] for r in asked.groupBy("cell").agg(F.min("floor").alias("f")).collect()}
    # by groups: a row a cell of queries, a column a cell of data
    at = centers[cells] @ centers[cells].T
    spread = np.maximum(reach, 0)[:, None]
    most = at + spread * lengths[cells][None, :] + (lengths[cells][:, None] + spread) * radius[None, :]
    bound = np.array([least.get(int(c), np.inf) for c in cells])[:, None]
    kept = (most * (1 + 1e-9) + 1e-6 + np.abs(at) * 1e-9 >= bound) & np.isfinite(reach)[:, None]
    np.fill_diagonal(kept, False)
    place = {int(c): i for i, c in enumerate(cells)}

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the other cells that may hold one of its k best."""
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x, group = matrix(batch.column("v"), dim), np.array([place[c] for c in batch.column("cell").to_pylist()], dtype=np.int64)
                norms = np.sqrt((x**2).sum(1))[:, None]
                inner = x @ centers[cells].T
                most = np.minimum(inner + norms * radius[None, :], norms * (lengths[cells] + radius)[None, :])
                slack = 1e-9 * (np.abs(inner) + norms * (radius[None, :] + 1)) + 1e-6
                row, col = np.nonzero(kept[group] & (most + slack >= np.asarray(batch.column("floor"))[:, None]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cells[col], pa.int32())], names=["vec_id", "v", "cell"])

    sent = asked.mapInArrow(replicate, "vec_id long, v array<double>, cell int")
    if tally is not None:
        groups, n = int(np.isfinite(reach).sum()), asked.count()
        tally.update(groups=groups * (len(cells) - 1), groups_kept=int(kept.sum()), queries=n * (len(cells) - 1), queries_kept=sent.count())
    far = meet(data, sent.withColumn("block", every_block), dim, k)
    return ranked(near.unionByName(far)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
    FROM vectors q, vectors d
    WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
