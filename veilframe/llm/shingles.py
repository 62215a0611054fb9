"""Word shingles of whole batches of texts as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = base
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashes of the shingles of ``size`` words; a text of fewer words is one shingle, one without words none.

    Words are separated by ASCII white space and A-Z are lower-cased. The hash of a run of bytes is a difference of prefix
    sums of a random polynomial over 64 bits, then mixed; a prefix sum serves all shingles of a batch.
    """

    def __init__(self, size: int):
        self.size = size
        self.up = _powers(_BASE, 1 << 19)
        self.down = _powers(_BACK, 1 << 19)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_BACK, 2 * n)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Per text, the sorted distinct hashes."""
        lot: list[bytes] = []
        held = 0
        for t in texts:
            lot.append(b" ".join((t or "").encode().lower().split()))
            held += len(lot[-1])
            if held > 1 << 18:
                yield from self._sets(lot)
                lot, held = [], 0
        yield from self._sets(lot)

    def _sets(self, lot: list[bytes]) -> Iterator[np.ndarray]:
        if not lot:
            return
        data = np.frombuffer(b"\n".join(lot) + b"\n", np.uint8)
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=total[1:])
        ends = np.flatnonzero((data == 32) | (data == 10))  # every word ends at a separator; an empty text leaves a lone one
        starts = np.concatenate([[0], ends[:-1] + 1])
        lines = np.cumsum([len(x) + 1 for x in lot]) - 1  # where each text ends
        upto = np.searchsorted(ends, lines, "right")
        first = 0
        for text, last in zip(lot, upto, strict=True):
            n = last - first
            if not text:
                yield np.empty(0, np.uint64)
            else:
                k = max(1, n - self.size + 1)
                a, b = starts[first : first + k], ends[first + min(self.size, n) - 1 : last]
                yield np.unique(mix((total[b] - total[a]) * self.down[a] ^ (b - a).astype(np.uint64)))
            first = last
