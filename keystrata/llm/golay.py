"""Fuzzy keys of 64-bit fingerprints from the perfect Golay code (23, 12, 7).

A fingerprint is cut into segments of 23, 23 and 18 bits (the last padded with zeros). A segment's keys are the
twelve-bit indices of all codewords within four bits of it: one, or six where the nearest codeword is three bits away.
Two segments that differ in at most one bit share a key, because a codeword within three bits of the one (there always
is one, the code being perfect) is within four bits of the other. If fingerprints differ in at most three bits, at
least two of three segments differ in at most one bit each (else two segments had two errors or more each). So keys of
pairs of segments bring every such pair of fingerprints together; many pairs further apart meet as well.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Fixed value: the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
NEAR = 4


@functools.cache
def parity() -> np.ndarray:
    """The eleven check bits of each twelve-bit message."""
    out = np.zeros(4096, dtype=np.uint32)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        out[message] = rest
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    return (words & np.uint32(0x7FF)) ^ parity()[words >> np.uint32(11)]


@functools.cache
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns of at most four bits that lead to a codeword, and how many there are."""
    errors = np.array([sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(23), n)], dtype=np.uint32)
    of = syndrome(errors)
    order = np.argsort(of, kind="stable")
    errors, of = errors[order], of[order]
    counts = np.bincount(of, minlength=2048)
    table = np.zeros((2048, counts.max()), dtype=np.uint32)
    table[of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)] = errors
    return table, counts


def indices(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords near each 23-bit segment, a row each, and how many of them count."""
    table, counts = patterns()
    s = syndrome(segments)
    return (segments[:, None] ^ table[s]) >> np.uint32(11), counts[s]


def segments(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = fingerprints.astype(np.uint64)
    low = lambda x: x.astype(np.uint32)
    return low(f >> np.uint64(41)), low((f >> np.uint64(18)) & np.uint64(0x7FFFFF)), low((f & np.uint64(0x3FFFF)) << np.uint64(5))


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of all fingerprints, and the place of the fingerprint each belongs to."""
    found = [indices(s) for s in segments(fingerprints)]
    out_keys, out_rows = [], []
    for number, (a, b) in enumerate(combinations(range(3), 2)):
        (left, n_left), (right, n_right) = found[a], found[b]
        for i in range(left.shape[1]):
            for j in range(right.shape[1]):
                rows = np.nonzero((n_left > i) & (n_right > j))[0]
                out_keys.append(np.uint32(number << 24) | left[rows, i] << np.uint32(12) | right[rows, j])
                out_rows.append(rows)
    return np.concatenate(out_keys).astype(np.int32), np.concatenate(out_rows)
