"""Simple-8b with escapes: integers packed into 64-bit words, encoded and decoded by NumPy operations.

A word's low four bits are its selector, which says how many integers of how many bits the other sixty hold. Integers
of ``escape_bits`` bits or more are written as the all-ones value of that width and kept apart, in order. Integers come
in blocks; each block starts a word, and offsets of its words and escapes let any block be decoded alone.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: selector -> (integers, bits of each).
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in SELECTORS], dtype=np.int64)
BLOCK, ESCAPE_BITS, MAGIC = 1024, 15, b"KS8B0001"


@dataclass
class Packed:
    n: int
    block: int
    escape_bits: int
    word_offsets: np.ndarray
    escape_offsets: np.ndarray
    words: np.ndarray
    escapes: np.ndarray

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIIQQQ", self.n, self.block, self.escape_bits, len(self.word_offsets), len(self.words), len(self.escapes))
        arrays = (self.word_offsets, self.escape_offsets, self.words, self.escapes)
        return head + b"".join(a.astype("<u8").tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[Packed, int]:
        n, block, bits, offsets, words, escapes = struct.unpack_from("<QIIQQQ", data, at)
        at += struct.calcsize("<QIIQQQ")
        arrays = []
        for count in (offsets, offsets, words, escapes):
            arrays.append(np.frombuffer(data, "<u8", count, at))
            at += 8 * count
        return cls(n, block, bits, *arrays), at


#: Bits of each number under 2**16.
SHORT_WIDTHS = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def bit_length(values: np.ndarray) -> np.ndarray:
    """Of unsigned integers under 2**60."""
    if values.max(initial=0) < 1 << 16:
        return SHORT_WIDTHS[values.astype(np.uint16)]
    low, high = values & np.uint64(0x3FFFFFFF), values >> np.uint64(30)
    width = lambda x: np.frexp(x.astype(np.float64))[1]  # noqa: E731  exact under 2**53
    return np.where(high > 0, width(high) + 30, width(low)).astype(np.uint8)


def encode(values: np.ndarray, block: int = BLOCK, escape_bits: int = ESCAPE_BITS) -> Packed:
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    mark = np.uint64((1 << escape_bits) - 1)
    escaped = values >= mark
    escapes = values[escaped]
    blocks = -(-n // block)
    wide = np.zeros((blocks, block + 240), dtype=np.uint64)
    padded = np.zeros(blocks * block, dtype=np.uint64)
    padded[:n] = np.where(escaped, mark, values)
    wide[:, :block] = padded.reshape(blocks, block)
    per_block = np.zeros(blocks * block, dtype=bool)
    per_block[:n] = escaped
    escape_offsets = np.concatenate([[0], np.cumsum(per_block.reshape(blocks, block).sum(1))]).astype(np.uint64)
    lengths = np.full(blocks, block, dtype=np.int64)
    if blocks:
        lengths[-1] = n - block * (blocks - 1)

    # the largest width among the next c integers, for each selector's c, by doubling
    widths = np.zeros((blocks, block + 480), dtype=np.uint8)
    widths[:, : block + 240] = bit_length(wide)
    best = np.full((blocks, block), 15, dtype=np.uint8)
    runs, size = {1: widths}, 1
    span = lambda c: runs[c] if c in runs else None
    for c in sorted({c for c, _ in SELECTORS}):
        while size * 2 <= c:
            prior = runs[size]
            size *= 2
            out = prior.copy()
            out[:, : prior.shape[1] - size // 2] = np.maximum(prior[:, : prior.shape[1] - size // 2], prior[:, size // 2 :])
            runs[size] = out
        if span(c) is None:
            prior, shift = runs[size], c - size
            out = prior.copy()
            out[:, : prior.shape[1] - shift] = np.maximum(prior[:, : prior.shape[1] - shift], prior[:, shift:])
            runs[c] = out
    for s in range(len(SELECTORS) - 1, -1, -1):
        c, bits = SELECTORS[s]
        best[runs[c][:, :block] <= bits] = s

    # all blocks step from word to word together
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    rows, starts, chosen = [], [], []
    while len(live):
        s = best[live, at[live]]
        rows.append(live)
        starts.append(at[live].copy())
        chosen.append(s)
        at[live] += COUNTS[s]
        live = live[at[live] < lengths[live]]
    if rows:
        row, start, sel = np.concatenate(rows), np.concatenate(starts), np.concatenate(chosen)
        order = np.argsort(row, kind="stable")  # a row's words were met in order
        row, start, sel = row[order], start[order], sel[order]
    else:
        row = start = np.zeros(0, dtype=np.int64)
        sel = np.zeros(0, dtype=np.uint8)
    words, flat = sel.astype(np.uint64), wide.ravel()
    for s, (c, bits) in enumerate(SELECTORS):
        where = np.nonzero(sel == s)[0]
        if bits and len(where):
            at_first = row[where] * wide.shape[1] + start[where]
            packed = words[where]
            for j in range(c):
                packed |= flat[at_first + j] << np.uint64(4 + j * bits)
            words[where] = packed
    word_offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))]).astype(np.uint64)
    return Packed(n, block, escape_bits, word_offsets, escape_offsets, words, escapes)


def decode(packed: Packed, first: int = 0, last: int | None = None) -> np.ndarray:
    """The integers of blocks ``first`` up to ``last``."""
    blocks = len(packed.word_offsets) - 1
    last = blocks if last is None else last
    if last <= first:
        return np.zeros(0, dtype=np.uint64)
    lo, hi = int(packed.word_offsets[first]), int(packed.word_offsets[last])
    words = packed.words[lo:hi]
    sel = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[sel]
    n = min(packed.n, last * packed.block) - first * packed.block
    offsets = packed.word_offsets[first : last + 1].astype(np.int64) - lo
    block_of = np.repeat(np.arange(last - first), np.diff(offsets))
    running = np.cumsum(counts) - counts
    start = running - running[offsets[block_of]] + block_of * packed.block
    end = np.minimum((block_of + 1) * packed.block, n)
    out = np.zeros(n, dtype=np.uint64)
    for s, (c, bits) in enumerate(SELECTORS):
        where = np.nonzero(sel == s)[0]
        if not bits or not len(where):
            continue
        mask = np.uint64((1 << bits) - 1)
        first_at, packed_words, stop = start[where], words[where], end[where]
        whole = bool((first_at + c <= stop).all())
        for j in range(c):
            values = (packed_words >> np.uint64(4 + j * bits)) & mask
            if whole:
                out[first_at + j] = values
            else:
                inside = first_at + j < stop
                out[first_at[inside] + j] = values[inside]
    marks = np.nonzero(out == np.uint64((1 << packed.escape_bits) - 1))[0]
    out[marks] = packed.escapes[int(packed.escape_offsets[first]) : int(packed.escape_offsets[last])]
    return out


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, documents' ids with their validity, their lengths, and the ids of all tokens in order."""
    valid = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<Q", len(doc_ids)) + valid.tobytes() + numbers.tobytes()
    return head + encode(lengths).to_bytes() + encode(ids).to_bytes()


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a token file of this format")
    (docs,) = struct.unpack_from("<Q", data, 8)
    valid = np.frombuffer(data, np.uint8, docs, 16)
    numbers = np.frombuffer(data, "<i8", docs, 16 + docs)
    lengths, at = Packed.from_bytes(data, 16 + 9 * docs)
    ids, at = Packed.from_bytes(data, at)
    if at != len(data):
        raise ValueError("the token file has another length than its header says")
    return [int(d) if v else None for d, v in zip(numbers, valid, strict=True)], decode(lengths).astype(np.int64), decode(ids)
