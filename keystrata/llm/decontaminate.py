"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts become canonical: lower case, runs of anything but letters and digits one space. An item of m characters may be
found with at most k edits, k = ``EDITS`` of m (less for short items, so that the lemma says something). A region with
at most k edits shares at least m - q + 1 - k q of the item's q-grams, on diagonals that differ by at most k. A task
looks up all q-grams of its documents in the items' index, counts hits by item and band of diagonals (bands of twice
k + 1 diagonals, k + 1 apart, so the diagonals of every such region lie whole in one), and aligns the item with the
regions whose count meets the bound, in a band. Every region within the budget is found. Items of fewer than q
characters allow no edit and are found verbatim, as whole words. Of items of more than ``LONG`` characters, windows of
``WINDOW``, half of that apart, are looked for beside the whole, each with its own budget, so that a document that holds
a long part of an item is found as well.

Scale: one pass over the documents, without a shuffle, whatever the number of documents that share a passage. The index
goes to the tasks in slices of at most ``SLICE_CHARS`` characters of benchmark text (16 bytes each); a larger benchmark
takes further passes. Hits are expanded in portions of at most ``PORTION``.

Defined results: null or empty documents match nothing; items of null text or without a letter or digit take no part;
null ids are carried; repeated documents give repeated rows, repeated items (same id and text) count
once; a region is reported once an item, at its least number of edits; windows that overlap are one region, at the most
edits of one of them, and are left out where the whole item is found. Other columns are carried by the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

Q, EDITS, WINDOW, LONG, SLICE_CHARS, PORTION = 10, 0.08, 100, 300, 4_000_000, 2_000_000
_OTHER = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def canonical(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def windows(text: str, size: int = WINDOW, long: int = LONG) -> list[str]:
    """Of a text of more than ``long`` characters, windows of whole words, each half a window after the one before."""
    out, at = [], 0
    while len(text) > long:
        end = text.find(" ", at + size)
        if end < 0:
            out.append(text[text.rfind(" ", 0, len(text) - size) + 1 :])
            break
        out.append(text[at:end])
        at = text.find(" ", at + size // 2) + 1
    return out


def budget(m: int, q: int = Q, edits: float = EDITS) -> int:
    """Edits allowed to an item of m characters: the share, or as many as leave the lemma's bound at 1 or more."""
    return max(0, min(int(edits * m), (m - q) // q))


def grams(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place: polynomials of lengths that double, then joined and mixed."""
    code = _code(text).astype(np.uint64)
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, size, have, out, used = int(_MIX), 1, code, None, 0
    rest = q
    while rest:
        if rest & 1:
            out = have[used : used + n].copy() if out is None else out * np.uint64(power) + have[used : used + n]
            used += size
        rest >>= 1
        if rest:
            have = have[: len(have) - size] * np.uint64(power) + have[size:]
            power, size = power * power % 2**64, 2 * size
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out * _MIX


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int] | None:
    """Least edits of the whole item against any part of the text with diagonals lo..hi (text place less item place),
    and where the first such part ends; None if over k."""
    width = hi - lo + 1
    steps = np.arange(width)
    far = k + 1
    row = np.where((steps + lo >= 0) & (steps + lo <= len(text)), 0, far)
    for i in range(1, len(item) + 1):
        place = i + lo + steps  # characters of the text used, by diagonal
        inside = (place >= 1) & (place <= len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[place[inside] - 1] == item[i - 1]
        step = np.where(inside, row + ~same, far)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step = np.where((place >= 0) & (place <= len(text)), step, far)
        row = np.minimum(np.minimum.accumulate(step - steps) + steps, far)
        if row.min() > k:
            return None
    at = int(row.argmin())
    return int(row[at]), len(item) + lo + at


@dataclass
class Index:
    """The q-grams of a slice of the benchmark."""

    ids: list
    parts: list[bool]  # whether an entry is a window of its item
    short: object | None  # an automaton of the short items
    texts: list[str]
    codes: list[np.ndarray]
    lengths: np.ndarray
    edits: np.ndarray
    q: int
    hashes: np.ndarray  # sorted, distinct
    starts: np.ndarray  # of each hash's places
    items: np.ndarray
    places: np.ndarray
    table: np.ndarray  # by the first bits of a hash: whether any is there

    @classmethod
    def build(cls, rows: list[tuple], q: int = Q, edits: float = EDITS) -> Index:
        every = sorted({(i, canonical(t)) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0], r[1]))
        short: dict[str, list] = {}
        for i, t in every:
            if 0 < len(t) < q:
                short.setdefault(f" {t} ", []).append(i)
        automaton = None
        if short:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, of in short.items():
                automaton.add_word(t, (len(t) - 2, of))
            automaton.make_automaton()
        whole = [(i, t, False) for i, t in every if len(t) >= q]
        texts = [*whole, *((i, w, True) for i, t, _ in whole for w in dict.fromkeys(windows(t)))]
        parts = [p for _, _, p in texts]
        texts = [(i, t) for i, t, _ in texts]
        found = [grams(t, q) for _, t in texts]
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        items = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int32)
        places = np.concatenate([np.arange(len(f)) for f in found]).astype(np.int32) if found else np.zeros(0, dtype=np.int32)
        order = np.argsort(flat, kind="stable")
        hashes, starts = np.unique(flat[order], return_index=True)
        mark = np.zeros(1 << _TABLE_BITS, dtype=bool)
        mark[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        lengths = np.array([len(t) for _, t in texts], dtype=np.int64)
        return cls([i for i, _ in texts], parts, automaton, [t for _, t in texts], [_code(t) for _, t in texts], lengths, np.array([budget(int(m), q, edits) for m in lengths], dtype=np.int64), q, hashes, np.append(starts, len(flat)), items[order], places[order], mark)

    def regions(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text, (item id, start, end, edits) of all regions, in canonical text."""
        plain = [canonical(t) for t in texts]
        return [long + self.short_regions(t) for long, t in zip(self.long_regions(plain), plain, strict=True)]

    def short_regions(self, text: str) -> list[tuple]:
        """Where short items stand as whole words."""
        if self.short is None or not text:
            return []
        found = ((i, end - 1 - n, end - 1) for end, (n, of) in self.short.iter(f" {text} ") for i in of)
        return [(i, start, end, 0) for i, start, end in found]

    def long_regions(self, plain: list[str]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in plain]
        if not len(self.hashes):
            return out
        # one string: q-grams over a line end match nothing
        begins = np.cumsum([0, *(len(t) + 1 for t in plain)])
        flat = grams("\n".join(plain), self.q)
        maybe = np.nonzero(self.table[(flat >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])[0]
        at = np.minimum(np.searchsorted(self.hashes, flat[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == flat[maybe]
        maybe, at = maybe[hit], at[hit]
        doc = np.searchsorted(begins, maybe, side="right") - 1
        place = maybe - begins[doc]
        times = self.starts[at + 1] - self.starts[at]
        shift = int(self.lengths.max()) + 1
        portions = np.searchsorted(np.cumsum(times), np.arange(0, times.sum() + PORTION, PORTION), side="left") if len(times) else [0]
        keys_all, counts_all = [], []
        cuts = sorted({0, *(min(int(p) + 1, len(times)) for p in portions), len(times)})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            n = times[lo:hi]
            src = np.repeat(np.arange(lo, hi), n)
            where = np.repeat(self.starts[at[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.items[where].astype(np.int64)
            band = (place[src] - self.places[where] + shift) // (self.edits[item] + 1)
            key = ((doc[src] * len(self.ids) + item) << 34) | band
            k, c = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys_all.append(k)
            counts_all.append(c)
        if not keys_all:
            return out
        key, back = np.unique(np.concatenate(keys_all), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate(counts_all)).astype(np.int64)
        item = (key >> 34) % len(self.ids)
        need = np.maximum(1, self.lengths[item] - self.q + 1 - self.edits[item] * self.q)
        for key_, item_ in zip(key[count >= need].tolist(), item[count >= need].tolist(), strict=True):
            d, band = (key_ >> 34) // len(self.ids), key_ & ((1 << 34) - 1)
            out[d].append((item_, band))
        return [self.verified(plain[d], bands) if bands else [] for d, bands in enumerate(out)]

    def verified(self, text: str, bands: list[tuple[int, int]]) -> list[tuple]:
        code, shift = _code(text), int(self.lengths.max()) + 1
        best: dict[int, list[tuple[int, int, int]]] = {}
        exact: dict[int, list[int]] = {}
        for item, band in sorted(bands):
            k, own = int(self.edits[item]), self.codes[item]
            lo = band * (k + 1) - shift
            hi = lo + 2 * (k + 1) - 1
            if item not in exact:
                exact[item] = places_of(self.texts[item], text)
                best[item] = [(at, at + len(own), 0) for at in exact[item]]
            if any(lo - k <= at <= hi + k for at in exact[item]):
                continue
            got = align(own, code, lo - k, hi + k, k)
            if got is None:
                continue
            edits, end = got
            back = align(own[::-1], code[:end][::-1], -k, k, k)
            start = end - (back[1] if back else len(own))
            found = best.setdefault(item, [])
            same = next((i for i, (s, e, _) in enumerate(found) if s < end and start < e), None)
            if same is None:
                found.append((start, end, edits))
            elif edits < found[same][2]:
                found[same] = (start, end, edits)
        whole = [(self.ids[item], *region) for item, found in sorted(best.items()) if not self.parts[item] for region in found]
        taken: dict = {}
        for i, start, end, _ in whole:
            taken.setdefault(i, []).append((start, end))
        joined: dict = {}
        for i, start, end, edits in sorted(((self.ids[item], *r) for item, found in best.items() if self.parts[item] for r in found), key=lambda r: r[1]):
            if any(start < e and s < end for s, e in taken.get(i, ())):
                continue
            own = joined.setdefault(i, [])
            if own and start < own[-1][1]:
                own[-1] = (own[-1][0], max(end, own[-1][1]), max(edits, own[-1][2]))
            else:
                own.append((start, end, edits))
        return whole + [(i, *r) for i, found in joined.items() for r in found]


def places_of(item: str, text: str) -> list[int]:
    """Where the item stands verbatim, without overlaps."""
    return [m.start() for m in re.finditer(re.escape(item), text)]


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def indexes(benchmark: DataFrame, q: int = Q, edits: float = EDITS, slice_chars: int = SLICE_CHARS) -> Iterator[Index]:
    """The benchmark's index in slices of bounded size."""
    own = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slices = max(1, -(-total // slice_chars))
    for i in range(slices):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).collect()
        yield Index.build([tuple(r) for r in rows], q, edits)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every region of a document that holds an item within its budget."""
    out = None
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in indexes(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in text_slices(batches):
                found = shared.value.regions(piece.column("text").to_pylist())
                rows = [(d, *r) for d, regions in zip(piece.column("doc_id").to_pylist(), found, strict=True) for r in regions]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

        part = own.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any such region, all columns as they are."""
    for index in indexes(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in text_slices(batches):
                found = shared.value.regions(piece.column("text").to_pylist())
                yield piece.filter(pa.array([not regions for regions in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
