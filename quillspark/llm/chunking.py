"""Content-defined chunks by a gear rolling hash with normalised boundaries."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import xxhash

#: One 32-bit value for each byte, by rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) & 0xFFFFFFFF for b in range(256)], np.uint32)
#: Bytes that a cut hangs on.
WINDOW = 16
#: Bytes hashed at a time, which bounds a worker's memory on a very long text.
BLOCK = 1 << 22


@dataclass(frozen=True)
class Sizes:
    """Bytes of a chunk: none is below least (but a text's last), a stricter test holds up to normal, a looser one up to most, where a cut is forced."""

    least: int
    normal: int
    most: int

    @property
    def masks(self) -> tuple[int, int]:
        """The two tests' masks, one bit more and one fewer than a mean of normal bytes asks for.

        They take the bits up to the WINDOW-th: a byte is shifted beyond them after so many more, so a cut hangs on
        WINDOW bytes only, and two texts with a passage in common cut it alike from its WINDOW-th byte on.
        """
        bits = max(2, round(np.log2(self.normal)))
        return tuple(((1 << b) - 1) << (WINDOW - b) for b in (bits + 1, bits - 1))  # type: ignore[return-value]


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, of the 32 bytes that end there: sums of shifted values, by doubling."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        shifted = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += shifted
    return h


def _passes(data: np.ndarray, masks: tuple[int, int]) -> list[np.ndarray]:
    """Where a chunk may end (before that byte), by either test; only between characters of UTF-8."""
    found: list[list[np.ndarray]] = [[], []]
    for at in range(0, len(data), BLOCK):
        back = min(at, 31)
        h = _gear(data[at - back : at + BLOCK])[back:]
        for k, mask in enumerate(masks):
            found[k].append(np.flatnonzero((h & np.uint32(mask)) == 0) + at + 1)
    out = []
    for parts in found:
        ends = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = ends[ends < len(data)]
        out.append(ends[(data[ends] & 0xC0) != 0x80])
    return out


def cuts(raw: bytes, sizes: Sizes) -> list[int]:
    """Ends of the chunks of a text in UTF-8, in order; the last is the text's end. None for an empty text."""
    n = len(raw)
    if n == 0:
        return []
    data = np.frombuffer(raw, np.uint8)
    strict, loose = (x.tolist() for x in _passes(data, sizes.masks))
    ends, at, i, j = [], 0, 0, 0
    while n - at > sizes.least:
        i = bisect_left(strict, at + sizes.least, i)
        if i < len(strict) and strict[i] <= at + sizes.normal:
            at = strict[i]
        else:
            j = bisect_left(loose, at + sizes.normal, j)
            if j < len(loose) and loose[j] <= at + sizes.most:
                at = loose[j]
            else:
                at = min(n, at + sizes.most)
                while at < n and raw[at] & 0xC0 == 0x80:
                    at += 1
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digests(raw: bytes, ends: list[int]) -> np.ndarray:
    """A 64-bit digest of each chunk."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)], np.uint64)
