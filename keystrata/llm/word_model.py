"""An interpolated modified Kneser-Ney model of word pairs that grows with the corpus, scored by sharded joins of counts.

Words are unfolded: runs of letters and digits as they stand, runs of other marks, and each character of scripts that don't
part words. A word that repeats the word before it is one symbol, so repetition is seen. Words are named by 64-bit
digests, so there is no vocabulary to hold: pairs, contexts and words are tables sharded by their keys.

With n(bc) the count of a pair, d its discount, g(b) the discounts' sum over a context and p(c) the probability of c by
the number of different words before it, a pair that was seen costs ``-log(g(b)/n(b.)) - log p(c) - log(1 + (n(bc) - d) /
(g(b) p(c)))``, and one that wasn't the same without its last term. So a text's cost is a sum of numbers of its words
and of its pairs, each looked up by itself; what the model doesn't hold adds nothing. The model is one table of key and
value, and scoring is one join of texts' keys with it.

The join: each task cuts the keys of a slice of texts by ranges of keys, packs what goes to one range into one cell
(sorted, as differences: about six bytes a key), and a task that holds a range of the model sums what it finds for each
text. The heaviest keys (those with a ``HEAVY``-th of all counts or more, so at most twice ``HEAVY``) are looked up where
the texts are, so no range gets a hot key. The keys are joined in ``ROUNDS`` rounds, a part of the ranges each: texts are
cut into words once a round, and only one round's cells are on disk.

Keys have 50 bits of a digest. Of 10**12 keys in a model, one in a thousand then meets another's value.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, text_slices
from .digests import CHUNK, digest, spans

#: Characters of scripts written without spaces: Thai to Tibetan, Burmese, Khmer, kana, Han and their extensions.
ALONE = "฀-࿿က-႟ក-៿⺀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
SPACE, LETTER, MARK, SINGLE = range(4)
#: Names that aren't digests; the repeats of one word have REPEAT and the numbers after it.
BEGIN, END, REPEAT = 1, 2, 3
#: Parts that counting, joining the values of one of those, and looking up are done in; share of all counts from which a key is looked up at
#: the texts; symbols of a slice at most (but for a longer text).
COUNT_ROUNDS, VALUE_ROUNDS, ROUNDS, HEAVY, SLICE_SYMBOLS = 2, 2, 3, 1 << 20, 1_000_000
#: Bits of a key; of a text's place in its slice; values are kept in steps of 1 / STEPS; keys of a range at most.
KEY_BITS, PLACE_BITS, STEPS, RANGE_KEYS = 50, 12, 1024, 16_000_000


@functools.cache
def classes() -> np.ndarray:
    """Of every character: white space, letter or digit, other mark, or a word by itself."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), MARK, dtype=np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\w+"), (SINGLE, f"[{ALONE}]+")):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def words_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in an array of characters, and their digests."""
    kind = classes()[code]
    change = np.empty(len(code), dtype=bool)
    change[:1] = True
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SINGLE)
    edge = np.append(np.nonzero(change)[0], len(code))
    word = kind[edge[:-1]] != SPACE
    start, end = edge[:-1][word], edge[1:][word]
    return start, spans(code, start, end)


def word_names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as digests, each text after a begin and before an end, and each text's length; 0 without words.
    What has more than CHUNK characters without white space is cut there."""
    joined = "\n".join([t or "" for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts, names, at = [], [], 0
    while at < len(code):
        upto = min(len(code), at + CHUNK)
        if upto < len(code):
            gaps = np.nonzero(classes()[code[at:upto]] == SPACE)[0]
            upto = at + int(gaps[-1]) + 1 if len(gaps) else upto
        start, name = words_of(code[at:upto])
        starts.append(start + at)
        names.append(name)
        at = upto
    start = np.concatenate(starts or [np.zeros(0, dtype=np.int64)])
    name = np.concatenate(names or [np.zeros(0, dtype=np.uint64)])
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    doc = np.searchsorted(ends, start, side="right")
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(name))
    again = np.zeros(len(name), dtype=bool)
    again[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    times = place - np.maximum.accumulate(np.where(again, 0, place)) if len(name) else place
    # the number of bits of how often the word has been repeated before
    name = np.where(again, np.uint64(REPEAT) + np.frexp(np.maximum(times - 1, 0).astype(np.float64))[1].astype(np.uint64), name)
    counts = np.where(n > 0, n + 2, 0)
    first = np.cumsum(counts) - counts
    out = np.full(counts.sum(), BEGIN, dtype=np.uint64)
    out[first[doc] + 1 + place - (np.cumsum(n) - n)[doc]] = name
    out[(first + counts - 1)[n > 0]] = END
    return out, counts


def key_of(*columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def packed(values: np.ndarray, numbers: np.ndarray, kind: str) -> bytes:
    """Sorted 64-bit values as differences, and a number beside each, by planes of bytes."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    beside = numbers.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes() + beside.tobytes())


def unpacked(cell: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    n = len(raw) // (8 + width)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(width, n).T).view(kind).ravel()


# the model


def count_pairs(texts: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(model, b, c, n) over all rows of (model, text), for those first words that fall into a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, chars=2_000_000):
            flat, counts = word_names(piece.column("text").to_pylist())
            model = np.repeat(piece.column("model").to_numpy(), counts)
            doc = np.repeat(np.arange(len(counts)), counts)
            own = (doc[1:] == doc[:-1]) & (flat[:-1] % np.uint64(parts) == np.uint64(part))
            model, b, c = model[:-1][own], flat[:-1][own], flat[1:][own]
            _, first, n = np.unique(digest(c, digest(b, model.astype(np.uint64))), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (model[first], b[first].view(np.int64), c[first].view(np.int64), n)], names=["model", "b", "c", "n"])

    return texts.select("model", "text").mapInArrow(run, "model long, b long, c long, n long").groupBy("model", "b", "c").agg(F.sum("n").alias("n"))


def count_tables(texts: DataFrame, parts: int = COUNT_ROUNDS) -> list[DataFrame]:
    """The counts of all pairs of (model, text), written in parts, sorted so that they take little room."""
    return [materialize(count_pairs(texts, i, parts).sortWithinPartitions("model", "b"), "kn-pairs") for i in range(parts)]


def discounts(counts: DataFrame, value: str) -> DataFrame:
    """d1, d2, d3 of each model, from the numbers of n-grams seen one to four times."""
    found = counts.groupBy("model").agg(*(F.sum((F.col(value) == i).cast("double")).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    fit = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)

    def d(i: int, least: float) -> Column:
        return F.when(fit, F.least(F.lit(float(i)), F.greatest(F.lit(0.1), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(least)).alias(f"d{i}")

    return found.select("model", d(1, 0.5), d(2, 1.0), d(3, 1.5))


def discounted(counts: DataFrame, value: str, limits: DataFrame) -> DataFrame:
    """``counts`` with ``off``, what is taken from each; ``limits`` has one row a model."""
    off = F.when(F.col(value) == 1, F.col("d1")).when(F.col(value) == 2, F.col("d2")).otherwise(F.col("d3"))
    return counts.join(F.broadcast(limits), "model").withColumn("off", F.least(off, F.col(value).cast("double"))).drop("d1", "d2", "d3")


class WordModel:
    """``values``: (key, value, n) of all models' words and pairs; ``unseen``: (model, unseen), the cost of a word that a
    model doesn't hold, a row a model."""

    def __init__(self, counts: list[DataFrame]):
        """From written tables (model, b, c, n), which are deleted."""
        pairs = counts[0]
        for other in counts[1:]:
            pairs = pairs.unionByName(other)
        limits = materialize(discounts(pairs, "n"), "kn-discounts")
        contexts = discounted(pairs, "n", limits).groupBy("model", "b").agg(F.sum("n").alias("n"), F.sum("off").alias("given"))
        contexts = materialize(contexts, "kn-contexts")
        words = materialize(pairs.groupBy("model", "c").agg(F.count("*").alias("k")), "kn-words")
        cut = discounted(words, "k", discounts(words, "k"))
        # one share more than there are words, for all words not seen
        whole = cut.groupBy("model").agg(F.sum("k").cast("double").alias("whole"), (F.sum("off") / F.sum("k") / (F.count("*") + 1)).alias("rest"))
        whole = materialize(whole, "kn-whole")
        chances = cut.join(F.broadcast(whole), "model").select("model", "c", "k", ((F.col("k") - F.col("off")) / F.col("whole") + F.col("rest")).alias("p"), "rest")
        chances = materialize(chances, "kn-chances")
        self.unseen = whole.select("model", (-F.log("rest")).alias("unseen"))

        seen = chances.select(F.col("model").alias("m"), F.col("c").alias("w"), (F.log("rest") - F.log("p")).alias("own"), "k")
        both = contexts.join(seen, (F.col("model") == F.col("m")) & (F.col("b") == F.col("w")), "full")
        named = both.select(F.coalesce("model", "m").alias("model"), F.coalesce("b", "w").alias("b"), F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce(F.log("n") - F.log("given"), F.lit(0.0)).alias("away"), F.coalesce("n", "k").alias("n"))
        tables = [materialize(self._kept(named, key_of("model", "b"), F.col("own") + F.col("away")), "kn-values")]
        for part, i in itertools.product(counts, range(VALUE_ROUNDS)):
            own = discounted(part.where(F.pmod(F.shiftright("b", 8), F.lit(VALUE_ROUNDS)) == i), "n", limits).join(contexts.drop("n").hint("shuffle_hash"), ["model", "b"])
            own = own.select("model", "c", key_of("model", "b", "c").alias("key"), ((F.col("n") - F.col("off")) / F.col("given")).cast("float").alias("x"), "n")
            own = own.join(chances.drop("rest", "k").hint("shuffle_hash"), ["model", "c"])
            tables.append(materialize(self._kept(own, F.col("key"), -F.log1p(F.col("x") / F.col("p"))), "kn-values"))
            if i == VALUE_ROUNDS - 1:
                forget(part)
        for done in (limits, contexts, words, chances):
            forget(done)
        self.values = tables[0]
        for other in tables[1:]:
            self.values = self.values.unionByName(other)
        self._held = [*tables, whole]

    @staticmethod
    def _kept(rows: DataFrame, key: Column, value: Column) -> DataFrame:
        step = F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.round(value * STEPS)))
        return rows.select(key.alias("key"), step.cast("short").alias("value"), F.col("n").cast("long").alias("n"))

    def heavy(self, share: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
        """Keys, sorted, with at least that share of the counts of all words, and their values."""
        total = self.values.agg(F.sum("n")).first()[0] or 0
        # words' counts and pairs' counts have the same sum, so at most twice ``share`` keys reach the limit
        rows = self.values.where(F.col("n") * F.lit(2 * share) >= F.lit(total)).select("key", "value").toArrow()
        key, value = rows.column("key").to_numpy(), rows.column("value").to_numpy()
        order = np.argsort(key)
        return key[order], value[order]

    def forget(self) -> None:
        for table in self._held:
            forget(table)


# scoring


def dealt(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that Spark's hash sends to it, so that numbered cells are spread evenly."""
    found: dict[int, int] = {}
    upto = 16 * n + 64
    while len(found) < n:
        rows = spark.range(upto).select(F.col("id").cast("int").alias("v")).select("v", F.pmod(F.hash("v"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("v").alias("v")).collect()
        found, upto = {r["p"]: r["v"] for r in rows}, 4 * upto
    return [found[p] for p in range(n)]


def entry_grams(flat: np.ndarray, counts: np.ndarray, models: list[list[int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """From texts' names, their lengths and each text's models. Entries are the texts with each of their models, at most
    2 ** PLACE_BITS at a time: for each its text, its model, and its symbols' number; and the distinct keys of words and
    pairs with the entry's place in the low bits, and how often."""
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(models)), [len(m) for m in models])
    model = np.array([x for m in models for x in m], dtype=np.int64).view(np.uint64)
    for at in range(0, len(row), 1 << PLACE_BITS):
        doc, own = row[at : at + (1 << PLACE_BITS)], model[at : at + (1 << PLACE_BITS)]
        length = counts[doc]
        place = np.repeat(np.arange(len(doc)), length)
        token = flat[np.repeat(starts[doc] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        word = digest(token, digest(own, np.full(len(own), 42, dtype=np.uint64))[place])
        follows = place[1:] == place[:-1]
        pair = digest(token[1:][follows], word[:-1][follows])
        low = np.uint64(PLACE_BITS)
        every = np.concatenate([word, pair]) >> np.uint64(64 - KEY_BITS) << low | np.concatenate([place, place[1:][follows]]).astype(np.uint64)
        every.sort()
        first = np.nonzero(np.diff(every, prepend=~every[:1]))[0]
        yield doc, own.view(np.int64), np.maximum(length - 1, 0), every[first], np.diff(first, append=len(every))


def text_groups(batches: Iterator[pa.RecordBatch], models_of: Callable[[str | None, int | None], list[int]]) -> Iterator[tuple]:
    """Names, lengths and models of as many texts as make a slice, with their keys."""
    held, symbols, entries = [], 0, 0
    for piece in text_slices(batches, chars=2_000_000):
        flat, counts = word_names(piece.column("text").to_pylist())
        names = [models_of(lang, half) for lang, half in zip(piece.column("lang").to_pylist(), piece.column("half").to_pylist(), strict=True)]
        more = sum(map(len, names))
        if held and (symbols + len(flat) > SLICE_SYMBOLS or entries + more > 1 << PLACE_BITS):
            yield tuple(np.concatenate(x) for x in list(zip(*held, strict=True))[:4]) + ([m for h in held for m in h[4]],)
            held, symbols, entries = [], 0, 0
        held.append((piece.column("k1").to_numpy(), piece.column("k2").to_numpy(), flat, counts, names))
        symbols, entries = symbols + len(flat), entries + more
    if held:
        yield tuple(np.concatenate(x) for x in list(zip(*held, strict=True))[:4]) + ([m for h in held for m in h[4]],)


def costs(texts: DataFrame, model: WordModel, models_of: Callable[[str | None, int | None], list[int]], rounds: int = ROUNDS) -> DataFrame:
    """(k1, k2, model, n, cost) for each row of (k1, k2, lang, half, text) and each model that ``models_of`` gives: the
    number of symbols, and the sum of what the model has for its words and pairs. Rows must come in the same order when
    a task is repeated, as they do from files."""
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = model.values.count()
    shards = max(1, -(-total // (rounds * RANGE_KEYS * partitions))) * partitions
    numbers = dealt(spark, partitions)
    heavy = spark.sparkContext.broadcast(model.heavy())
    low = np.uint64(PLACE_BITS)
    parts = []
    for turn in range(rounds):
        # of the whole space of keys, this round's part, cut into equal ranges
        edges = np.array([((turn * shards + i) << KEY_BITS) // (rounds * shards) for i in range(shards + 1)], dtype=np.uint64)

        def cells(batches: Iterator[pa.RecordBatch], edges=edges, turn=turn) -> Iterator[pa.RecordBatch]:
            known, worth = heavy.value
            known = known.astype(np.uint64)
            number, task = 0, TaskContext.get().partitionId()
            for k1, k2, flat, counts, names in text_groups(batches, models_of):
                for doc, own, length, every, n in entry_grams(flat, counts, names):
                    slice_id, number = (task << 32) | number, number + 1
                    key = every >> low
                    lo, hi = np.searchsorted(key, edges[[0, -1]])
                    key, every, n = key[lo:hi], every[lo:hi], n[lo:hi]
                    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                    there = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
                    place = (every[there] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
                    here = np.bincount(place, weights=n[there] * worth[at[there]].astype(np.float64), minlength=len(doc)) if len(known) else np.zeros(len(doc))
                    key, every, n = key[~there], every[~there], np.minimum(n[~there], 65535)
                    bounds = np.searchsorted(key, edges)
                    ranges = np.nonzero(np.diff(bounds))[0]
                    head = pa.RecordBatch.from_arrays([pa.array(k1[doc]), pa.array(k2[doc]), pa.array(own), pa.array(length), pa.array(here)], names=["k1", "k2", "model", "n", "cost"])
                    with pa.BufferOutputStream() as out:
                        with pa.ipc.new_stream(out, head.schema) as writer:
                            writer.write_batch(head)
                        blob = out.getvalue().to_pybytes()
                    blobs = [blob, *(packed(every[bounds[r] : bounds[r + 1]], n[bounds[r] : bounds[r + 1]], "<u2") for r in ranges)]
                    shard = np.concatenate([[slice_id % len(numbers)], ranges])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([numbers[s % len(numbers)] for s in shard], pa.int32()), pa.array(shard, pa.int32()), pa.array([2] + [1] * len(ranges), pa.int32()), pa.array([slice_id] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())],
                        names=["deal", "shard", "kind", "slice", "cell"],
                    )

        def model_cells(batches: Iterator[pa.RecordBatch], edges=edges) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def out() -> pa.RecordBatch:
                key, value = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.argsort(key)
                key, value = key[order], value[order]
                bounds = np.searchsorted(key, edges)
                ranges = np.nonzero(np.diff(bounds))[0]
                blobs = [packed(key[bounds[r] : bounds[r + 1]], value[bounds[r] : bounds[r + 1]], "<i2") for r in ranges]
                return pa.RecordBatch.from_arrays(
                    [pa.array([numbers[s % len(numbers)] for s in ranges], pa.int32()), pa.array(ranges, pa.int32()), pa.array([0] * len(blobs), pa.int32()), pa.array([0] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["deal", "shard", "kind", "slice", "cell"],
                )

            for batch in batches:
                held.append((batch.column("key").to_numpy().astype(np.uint64), batch.column("value").to_numpy()))
                if sum(len(k) for k, _ in held) > 1_000_000:
                    yield out()
            if held:
                yield out()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The model's cells of a range come first, then those of the slices; a slice's head passes through."""
            of, found, known, worth = None, [], None, None
            for batch in batches:
                out = [], [], []
                for shard, kind, name, cell in zip(*(batch.column(c) for c in ("shard", "kind", "slice", "cell")), strict=True):
                    shard, kind, name = shard.as_py(), kind.as_py(), name.as_py()
                    if kind == 2:
                        for to, x in zip(out, (name, 0, cell.as_py()), strict=True):
                            to.append(x)
                        continue
                    if shard != of:
                        of, found, known = shard, [], None
                    if kind == 0:
                        found.append(unpacked(cell.as_py(), "<i2"))
                        continue
                    if known is None:
                        known, worth = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int16))
                        order = np.argsort(known, kind="stable")
                        known, worth, found = known[order], worth[order], []
                    if not len(known):
                        continue
                    every, n = unpacked(cell.as_py(), "<u2")
                    at = np.minimum(np.searchsorted(known, every >> low), len(known) - 1)
                    hit = known[at] == every >> low
                    if hit.any():
                        place = (every[hit] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
                        sums = np.bincount(place, weights=n[hit] * worth[at[hit]].astype(np.float64))
                        for to, x in zip(out, (name, 1, zstandard.ZstdCompressor(level=1).compress(sums.astype("<i8").tobytes())), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["slice", "kind", "cell"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A slice's head comes first, then the sums from all ranges."""
            head, total = None, None

            def out() -> pa.RecordBatch:
                return head.set_column(4, "cost", pa.array(total / STEPS))

            for batch in batches:
                for kind, cell in zip(batch.column("kind").to_pylist(), batch.column("cell"), strict=True):
                    if kind == 0:
                        if head is not None:
                            yield out()
                        with pa.ipc.open_stream(cell.as_py()) as reader:
                            head = reader.read_next_batch()
                        total = head.column("cost").to_numpy().copy()
                    else:
                        more = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell.as_py()), dtype="<i8")
                        total[: len(more)] += more
            if head is not None:
                yield out()

        schema = "deal int, shard int, kind int, slice long, cell binary"
        inside = (F.col("key") >= int(edges[0])) & (F.col("key") < int(edges[-1]))
        both = texts.mapInArrow(cells, schema).unionByName(model.values.where(inside).select("key", "value").mapInArrow(model_cells, schema))
        met = both.repartition(partitions, "deal").sortWithinPartitions("shard", "kind").mapInArrow(meet, "slice long, kind int, cell binary")
        found = met.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(summed, "k1 long, k2 long, model long, n long, cost double")
        parts.append(materialize(found.groupBy("k1", "k2", "model").agg(F.max("n").alias("n"), F.max("cost").alias("cost")), "kn-costs"))
    heavy.destroy()
    whole = parts[0]
    for other in parts[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("k1", "k2", "model").agg(F.max("n").alias("n"), F.sum("cost").alias("cost"))
