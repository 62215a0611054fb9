"""Parity sketches of sets and the pigeonhole keys drawn from them.

A set's elements, 64-bit hashes, are dealt over the parts of a sketch, and each part is the XOR of its elements. An element in
one of two sets alone changes one part, so the number of parts that differ is a lower bound of the symmetric difference.
Sets that reach a Jaccard similarity of t differ in at most (1 - t) / (1 + t) * (|A| + |B|) elements, d say; of any d + 1 parts
that hold elements, one is then equal in both. The value of that part is a key that both sets emit.

Sketches are made per size band, so that both sets of a pair deal their elements over the same number of parts: a set
emits keys of its own band and, if a partner may be large enough to fall into the next one, keys of the next band.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from veilframe.llm.shingles import mix


def bit_sketch(hashes: np.ndarray) -> bytes:
    """A set as parities of its elements over four bits or more per element, a power of two in all."""
    bits = 1 << max(6, (4 * len(hashes) - 1).bit_length())
    at = (hashes >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Bit sketches as rows of one length: a longer one folds onto itself, which keeps every element's parity."""
    least = min(map(len, sketches))
    rows = []
    for s in sketches:
        x = np.frombuffer(s, np.uint8)
        while len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    return np.stack(rows)


def hamming(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits in which a sketch differs from others: at most the elements in which the sets differ."""
    return np.bitwise_count(one ^ many).sum(1, dtype=np.int64)


@dataclass(frozen=True)
class Bands:
    """Integer similarity threshold in percent, and the ratio of successive band limits."""

    percent: int = 85
    ratio: float = 1.6
    spare: int = 4

    @property
    def share(self) -> float:
        return (100 - self.percent) / (100 + self.percent)

    def most(self, n: int) -> int:
        """Size of the largest partner of a set of n elements."""
        return 100 * n // self.percent

    @cached_property
    def limits(self) -> list[int]:
        """Sizes at which bands begin, up to any size that fits in memory."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * self.ratio)))
        return out

    def band(self, n: int) -> int:
        import bisect

        return bisect.bisect_right(self.limits, n) - 1

    def parts(self, band: int) -> int:
        """Parts of a band's sketches: what its largest sets may differ in, and some more for parts left empty."""
        top = self.limits[band + 1] - 1
        return math.ceil(1.12 * (self.differ(top, top) + 1)) + 12 + self.spare

    def differ(self, a: int, b: int) -> int:
        """Most elements in which linked sets of these sizes differ."""
        return math.floor((100 - self.percent) * (a + b) / (100 + self.percent) + 1e-9)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The keys of a set of distinct hashes; a set whose partners can only equal it needs none."""
        n = len(hashes)
        if n == 0 or self.most(n) == n:
            return np.empty(0, np.int64)
        own = self.band(n)
        out = [self._keys(hashes, own, min(self.most(n), self.limits[own + 1] - 1))]
        if self.most(n) >= self.limits[own + 1]:
            out.append(self._keys(hashes, own + 1, self.most(n)))
        return np.concatenate(out).view(np.int64)

    def _keys(self, hashes: np.ndarray, band: int, partner: int) -> np.ndarray:
        parts = self.parts(band)
        at = ((hashes >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)  # hashes are sorted, and so are their parts
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        value = np.bitwise_xor.reduceat(hashes, new)
        need = self.differ(len(hashes), partner) + 1 + self.spare
        return mix(value[:need] ^ mix(at[new][:need] + np.uint64(band << 44)))

    def emitted(self, n: int, band: int) -> int:
        """Keys that a set of n elements emits in a band, unless it fills fewer parts."""
        own = self.band(n)
        return self.differ(n, min(self.most(n), self.limits[own + 1] - 1) if band == own else self.most(n)) + 1 + self.spare

    def need(self, a: int, b: int) -> int:
        """Keys that linked sets of these sizes share at least. Sets of few elements may fill fewer parts than they are to emit:
        of those only one shared key is asked. From ``sure`` elements on, the odds of that are below one in ten million."""
        if min(a, b) < self.sure:
            return 1
        band = max(self.band(a), self.band(b))
        return min(self.emitted(a, band), self.emitted(b, band)) - self.differ(a, b)

    @property
    def sure(self) -> int:
        return 60
