"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the bytes before has four given bits zero and no such place is within ``LEAST``
bytes before, or ``MOST`` bytes after the last end. Where that leaves ``LONG`` bytes or more without an end, as in a word
that is repeated over and over, chunks also end where the hash is least among ``NEAR`` places; equal least places in a
row are one period apart, and of these as many are left out as make a chunk of ``LEAST`` bytes. Where a chunk ends depends
on the 28 to 40 bytes before (but for the cut at MOST, and which stretches are long), so a passage has the same inner
chunks wherever it stands, whatever was inserted before. Chunks are named by a 64-bit digest; a digest that occurs in two documents or more is repeated. Repeated chunks that follow each other make
a passage, reported from ``PASSAGE`` bytes on: random equal chunks and short common lines stay below, a passage of over
50 words stays above, also of short words and without its first and last chunk. Texts that are shorter than that are
reported where they equal another document's whole text. The first document (smallest id) that holds a chunk is its home; elsewhere it can be removed.

Scale: equal chunks that follow each other in a text are one row, so a text of one repeated word gives few. Digests are
counted with partial sums and joined back by digest. A digest may be on a third of all rows: its
counts are summed before the shuffle, and the join is one that adaptive execution splits. Only a document's own chunks
meet in one task. Nothing is broadcast or collected.

Defined results: null or empty text and null ids take no part; rows that repeat an id count as one document, so their
text repeats nothing by itself; a document with no passage has no row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, text_slices

LEAST, MOST, PASSAGE, WINDOW = 12, 512, 80, 16
LONG, NEAR = 96, 24
#: Seed of the digests of whole texts, which never equal those of chunks.
WHOLE_SEED = 1
#: The gear table: a random 32-bit number for each byte, the same in every run.
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where chunks end (after which byte), but for the last. Each place's gear hash is summed by doubling: the bits
    that are looked at depend on the last ``WINDOW`` bytes only."""
    h = GEAR[data]
    size = 1
    while size < WINDOW:
        h[size:] = h[size:] + (h[:-size] << np.uint32(size))
        size *= 2
    found = np.nonzero((h >> np.uint32(WINDOW - 5)) & np.uint32(15) == 0)[0] + 1
    found = found[np.diff(found, prepend=-LEAST) >= LEAST] if len(found) else found
    ends = np.concatenate([[0], found, [len(data)]])
    gaps = np.diff(ends)
    if gaps.max() < LONG:
        return found
    more = least_places(h & np.uint32((1 << (WINDOW - 1)) - 1))
    gap = np.searchsorted(ends, more, "right") - 1
    more, gap = more[more < len(data)], gap[more < len(data)]
    inner = (gaps[gap] >= LONG) & (more - ends[gap] >= LEAST) & (ends[gap + 1] - more >= LEAST)
    return np.sort(np.concatenate([found, more[inner]]))


def least_places(h: np.ndarray) -> np.ndarray:
    """The ends after places whose hash is the least of the last ``NEAR``; of equal ones in a row, every so many."""
    low, reach = h, 1
    while reach < NEAR:
        step = min(reach, NEAR - reach)
        low = np.concatenate([low[:step], np.minimum(low[step:], low[:-step])])
        reach += step
    at = np.nonzero(h == low)[0]
    period = np.diff(at, prepend=-NEAR - 1)
    first = np.append(True, h[at[1:]] != h[at[:-1]]) | (period > NEAR)
    place = np.arange(len(at))
    place -= np.maximum.accumulate(np.where(first, place, 0))
    return at[place % -(-LEAST // period) == 0] + 1


def chunks(coded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's chunks."""
    inner = cuts(np.frombuffer(coded, dtype=np.uint8))
    ends = np.append(inner[inner < len(coded)], len(coded))
    starts = np.concatenate([[0], ends[:-1]])
    pieces = -(-(ends - starts) // MOST)
    if (pieces > 1).any():
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + step * MOST
        ends = np.minimum(np.repeat(ends, pieces), starts + MOST)
    return starts, ends


def digests(texts: list[str | None], short: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every chunk of every text: the text's place, the digest, start and end in bytes, and whether it is a whole
    text, which those under ``short`` bytes give beside their chunks. Equal chunks in a row are one."""
    from xxhash import xxh3_64_intdigest

    rows, names, starts, ends, whole = [], [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        coded = text.encode("utf-8", "surrogatepass")
        s, e = chunks(coded)
        name = np.array([xxh3_64_intdigest(coded[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)], dtype=np.uint64)
        again = name[1:] == name[:-1]
        if again.any():
            first = np.append(True, ~again)
            name, s = name[first], s[first]
            e = np.append(s[1:], e[-1])
        alone = len(coded) < short
        if alone:
            name = np.append(name, np.uint64(xxh3_64_intdigest(coded, WHOLE_SEED)))
            s, e = np.append(s, 0), np.append(e, len(coded))
        names.append(name)
        rows.append(np.full(len(s), i))
        starts.append(s)
        ends.append(e)
        whole.append(np.arange(len(s)) >= len(s) - alone)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(rows or none), np.concatenate(names or none).view(np.int64), np.concatenate(starts or none), np.concatenate(ends or none), np.concatenate(whole or [np.zeros(0, dtype=bool)])


def chunk_table(docs: DataFrame, short: int = 0) -> DataFrame:
    """(digest, doc_id, start, size, whole): a row a chunk, and one for each whole text under ``short`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, chars=1_000_000):
            row, name, start, end, whole = digests(piece.column("text").to_pylist(), short)
            ids = piece.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(name), ids, pa.array(start, pa.int64()), pa.array((end - start).astype(np.int32)), pa.array(whole)], names=["digest", "doc_id", "start", "size", "whole"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return own.mapInArrow(run, "digest long, doc_id long, start long, size int, whole boolean")


def passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """(doc_id, start, end, removable): repeated passages in bytes, and how many of their bytes have a home elsewhere."""
    rows = chunk_table(docs, least)
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).where("home < last").select(F.col("digest").alias("d"), "home")
    found = rows.join(repeated, F.col("digest") == F.col("d")).select("doc_id", "whole", "start", "size", (F.col("home") < F.col("doc_id")).alias("elsewhere"))
    in_doc = Window.partitionBy("doc_id", "whole").orderBy("start", "size")
    before = in_doc.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    # rows that repeat an id give their chunks twice: a chunk that ends no later than those before adds nothing
    placed = found.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(-1).cast("long")))
    placed = placed.withColumn("run", F.sum((F.col("start") > F.col("reach")).cast("long")).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest("start", "reach"))
    runs = placed.groupBy("doc_id", "whole", "run").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.sum(F.when(F.col("elsewhere"), fresh).otherwise(F.lit(0))).cast("long").alias("removable"))
    return runs.where(F.col("whole") | (F.col("end") - F.col("start") >= least)).drop("run", "whole")


def repeated_documents(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """A row for each document that holds a repeated passage: its passages, their bytes, and those removable."""
    found = passages(docs, least)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_passages"),
        F.sum(F.col("end") - F.col("start")).alias("repeated_bytes"),
        F.sum("removable").alias("removable_bytes"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )


def cut_repeats(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """The documents with passages cut that lie wholly in homes elsewhere; all columns as they are, whatever their names."""
    fields = docs.columns
    key, cut_at = (f"_{c}_{'_'.join(fields)}" for c in ("id", "spans"))  # names that no column has
    spans = passages(docs, least).where(F.col("removable") == F.col("end") - F.col("start"))
    spans = spans.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut_at))
    joined = docs.join(spans, docs["doc_id"] == F.col(key), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            out = []
            for text, cut in zip(piece.column("text").to_pylist(), piece.column(cut_at).to_pylist(), strict=True):
                if cut and text:
                    coded, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
                    for span in cut:
                        kept.append(coded[at : span["start"]])
                        at = span["end"]
                    text = b"".join([*kept, coded[at:]]).decode("utf-8", "ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else piece.column(c) for c in fields], names=fields)

    return joined.mapInArrow(run, docs.schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_documents(table(spark, sf_dir, "documents")).drop("spans")
