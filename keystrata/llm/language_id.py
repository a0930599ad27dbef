"""Language ID by hierarchical discrimination: a family of languages first, then one-versus-one linear SVMs in it.

Features are hashed counts of byte pairs and triples of the whole lower-case text, damped by a square root and brought
to length one. Families are found in the training rows: languages' mean vectors are clustered by similarity and the
tree is cut at its widest gap. One linear SVM a family (against the rest) chooses the family; inside it a linear SVM for
each pair of languages votes.

Learning takes a bounded sample of labelled rows (``TRAIN_ROWS`` over all languages and ``LEAST_ROWS`` of each at least,
the first by a digest of text and id); counts of labels cover all rows, and every language is learned. Prediction is one
pass over the rows without a shuffle; the model is a few vectors a language and goes to the tasks with the function.

Defined results: null text, or text without a letter, is ``und`` with score 0; a null id is never held out and never
learned from; with nothing to learn from, every text is ``und``; with one language, every text with letters is it, with
score 1; ties go to the language that sorts first; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, text_slices

#: Buckets of hashed features; rows to learn from over all languages, and of each at least.
BUCKETS, TRAIN_ROWS, LEAST_ROWS = 4096, 2000, 8
#: ASCII that is no letter becomes a space; other bytes stay.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(texts: list[str | None]) -> np.ndarray:
    """A row of ``BUCKETS`` numbers for each text."""
    coded = [b" " + (t or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" " for t in texts]
    lengths = np.array([len(c) for c in coded], dtype=np.int64)
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64)
    doc = np.repeat(np.arange(len(coded)), lengths)
    out = np.zeros(len(coded) * BUCKETS)
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(data) < n:
            continue
        key = data[n - 1 :].copy()
        for j in range(1, n):
            key |= data[n - 1 - j : len(data) - j] << np.uint64(8 * j)
        bucket = (((key * np.uint64(salt)) & np.uint64(0xFFFFFFFF)) >> np.uint64(20)).astype(np.int64)
        whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
        out += np.bincount(doc[n - 1 :][whole] * BUCKETS + bucket[whole], minlength=len(out))
    out = np.sqrt(out.reshape(len(coded), BUCKETS))
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 20) -> np.ndarray:
    """Weights (the last is the offset) of a linear SVM with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x**2).sum(1) + 1 / (2 * c)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c)
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def families(centers: np.ndarray) -> list[list[int]]:
    """Languages by family: average-link clustering of mean vectors, cut where the similarity falls most."""
    unit = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    similar = unit @ unit.T
    groups = [[i] for i in range(len(centers))]
    stages, heights = [[list(g) for g in groups]], [1.0]
    while len(groups) > 1:
        height, a, b = max((similar[np.ix_(groups[a], groups[b])].mean(), -a, -b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        a, b = -a, -b
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
        heights.append(float(height))
        stages.append([list(g) for g in groups])
    if len(centers) < 3:
        return stages[-1]
    falls = [heights[i] - heights[i + 1] for i in range(1, len(heights) - 1)]
    return sorted(stages[1 + int(np.argmax(falls))])


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -15, 15)))


@dataclass
class Model:
    languages: list[str]
    groups: list[list[int]]
    family: np.ndarray  # a row a family, or none
    pairs: dict[tuple[int, int], np.ndarray]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        x = np.hstack([features(texts), np.ones((len(texts), 1), dtype=np.float32)])
        if len(self.groups) > 1:
            margins = x @ self.family.T
            chosen, chance = margins.argmax(1), _chance(margins.max(1))
        else:
            chosen, chance = np.zeros(len(texts), dtype=np.int64), np.ones(len(texts))
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        for g, members in enumerate(self.groups):
            rows = np.nonzero(chosen == g)[0]
            votes, sure = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    p = _chance(x[rows] @ self.pairs[a, members[j]])
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    sure[:, i] += p
                    sure[:, j] += 1 - p
            best = (votes + sure / (2 * len(members))).argmax(1) if len(members) > 1 else np.zeros(len(rows), dtype=np.int64)
            for k, (r, b) in enumerate(zip(rows, best, strict=True)):
                if texts[r] and any(map(str.isalpha, texts[r])):
                    inside = sure[k, b] / (len(members) - 1) if len(members) > 1 else 1.0
                    out[r] = (self.languages[members[b]], float(chance[r] * inside))
        return out


def train(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    of = np.array([languages.index(v) for v in labels], dtype=np.int64)
    if not languages:
        return Model([], [], np.zeros((0, BUCKETS + 1)), {})
    groups = families(np.stack([x[of == i].mean(0) for i in range(len(languages))]))
    group_of = {m: g for g, members in enumerate(groups) for m in members}
    g = np.array([group_of[i] for i in of])
    family = np.stack([train_svm(x, np.where(g == k, 1.0, -1.0)) for k in range(len(groups))]) if len(groups) > 1 else np.zeros((0, BUCKETS + 1))
    pairs = {}
    for members in groups:
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = (of == a) | (of == b)
                pairs[a, b] = train_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0)).astype(np.float32)
    return Model(languages, groups, family.astype(np.float32), pairs)


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from a sample of the rows with a label, about as many of each language."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return train(np.zeros((0, BUCKETS), dtype=np.float32), [])
    each = max(LEAST_ROWS, train_rows // languages)
    # a row a language goes to all tasks, so only chosen texts are moved: rows with small digests, about twice as many as are wanted; then the first of each language, whichever tasks hold them
    digest = F.pmod(F.xxhash64("text", "id"), F.lit(1 << 30))
    share = counts.select(F.col("lang").alias("of"), F.least(F.lit(1.0), 2 * each / F.col("n") + 8 / F.col("n")).alias("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "id", "text"))
    near = rows.withColumn("digest", digest).join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.col("digest") < F.col("share") * (1 << 30))
    chosen = near.withColumn("place", place).where(F.col("place") <= each)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            x = features(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    found = chosen.select("lang", "text").mapInArrow(extract, "lang string, x binary").toArrow()
    pairs = sorted(zip(found.column("lang").to_pylist(), found.column("x").to_pylist(), strict=True))
    x = np.frombuffer(b"".join(p[1] for p in pairs), dtype=np.float32).reshape(-1, BUCKETS)
    return train(x, [p[0] for p in pairs])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            got = model.predict(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.drop("lang"), model)
