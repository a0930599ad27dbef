"""Digests of many words at once, in arrays."""

from __future__ import annotations

import functools

import numpy as np

#: Characters or bytes that are cut into words at once.
CHUNK = 1 << 20
#: The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def digest(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of a long, as the SQL function ``xxhash64`` chains it over its arguments (the first seed is 42)."""
    u = np.uint64
    h = (seed + u(P5) + u(8)) ^ (_turned(value.astype(np.uint64) * u(P2), 31) * u(P1))
    h = _turned(h, 27) * u(P1) + u(P4)
    h = (h ^ (h >> u(33))) * u(P2)
    h = (h ^ (h >> u(29))) * u(P3)
    return h ^ (h >> u(32))


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    return tuple(np.cumprod(np.full(CHUNK, p % 2**64, dtype=np.uint64)) for p in (P1, pow(P1, -1, 2**64)))


def spans(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of spans of an array of at most CHUNK small numbers: polynomials of the numbers, mixed with the length."""
    up, down = powers()
    sums = np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)])
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    return digest((sums[end - 1] - before) * down[start], (end - start).astype(np.uint64))


def byte_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all texts' words (A-Z in lower case, cut at ASCII white space), and how many each text has. What has
    more than CHUNK bytes without white space is cut there."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded).translate(LOWER), dtype=np.uint8)
    starts, names, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], 0
    while at < len(data):
        upto = min(len(data), at + CHUNK)
        space = SPACES[data[at:upto]]
        if upto < len(data):
            gaps = np.nonzero(space)[0]
            upto = at + int(gaps[-1]) + 1 if len(gaps) else upto
            space = space[: upto - at]
        turn = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
        start, end = np.nonzero(turn == -1)[0], np.nonzero(turn == 1)[0]
        starts.append(start + at)
        names.append(spans(data[at:upto], start, end))
        at = upto
    doc = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), np.concatenate(starts), side="right")
    return np.concatenate(names), np.bincount(doc, minlength=len(texts))
