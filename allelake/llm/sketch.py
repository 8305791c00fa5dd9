"""A mergeable quantile sketch of relative-rank compactors.

Each level holds items of weight 2**level. A full level keeps its largest items
(one tail is protected) and compacts sections at the small end: of each two
neighbours one goes up. How many sections go is given by the number of trailing
ones of the level's compaction counter, so the rank error near the protected
end is a small share of the distance to that end: at rank r of n the standard
error is about ``error(n - r)``. Up to one buffer of items the sketch is exact.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import numpy as np

#: Values of ``section`` give the accuracy; the default's standard error is about 0.15 % of (n - rank).
SECTION = 128
_SECTIONS = 4


class RankSketch:
    """Quantiles of doubles, exact to a small share of the distance from the top."""

    __slots__ = ("section", "n", "levels", "counts", "least", "most")

    def __init__(self, section: int = SECTION) -> None:
        if section < 4 or section % 2:
            raise ValueError("section must be even and at least 4")
        self.section, self.n = section, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.counts: list[int] = [0]  # compactions so far, by level
        self.least, self.most = math.inf, -math.inf

    def _shape(self, level: int) -> tuple[int, int]:
        """Section size and number of sections: with each squaring of the compactions there are twice as many, narrower by the root of two."""
        doublings = max(0, (int(self.counts[level] + 1).bit_length() - 1).bit_length() - 2)
        size = max(4, 2 * round(self.section / 2 ** (doublings / 2) / 2))
        return size, _SECTIONS * 2**doublings

    def _capacity(self, level: int) -> int:
        size, sections = self._shape(level)
        return 2 * size * sections

    def add(self, values: np.ndarray) -> None:
        """Add finite values; NaN must be left out by the caller."""
        values = np.asarray(values, dtype=np.float64)
        step = 1 << 16
        for i in range(0, len(values), step):
            part = values[i : i + step]
            self.n += len(part)
            self.least, self.most = min(self.least, part.min()), max(self.most, part.max())
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._compress()

    def merge(self, other: RankSketch) -> None:
        """Add another sketch's levels; ``other`` stays as it is."""
        if other.section != self.section:
            raise ValueError("sketches of different accuracy can't be merged")
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        for level, items in enumerate(other.levels):
            self._reach(level)
            self.levels[level] = np.concatenate([self.levels[level], items])
            self.counts[level] |= other.counts[level]
        self._compress()

    def _reach(self, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.empty(0))
            self.counts.append(0)

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= self._capacity(level):
                self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        items, count = np.sort(self.levels[level]), self.counts[level]
        size, sections = self._shape(level)
        ones = ((count + 1) & -(count + 1)).bit_length() - 1
        kept = size * (2 * sections - min(sections, ones + 1))  # at least half of a buffer
        take = (len(items) - kept) // 2 * 2
        self.counts[level] += 1
        # A fixed mixing of counter and level stands for the coin, so a retried task builds the same sketch.
        coin = ((count * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03 + len(items)) >> 17) & 1
        self._reach(level + 1)
        self.levels[level + 1] = np.concatenate([self.levels[level + 1], items[:take][coin::2]])
        self.levels[level] = items[take:]

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        return items[order], np.cumsum(weights[order])

    def error(self, above: float) -> float:
        """Standard error of the rank at a place with ``above`` values above it; 0 where nothing was compacted."""
        return 0.0 if len(self.levels) == 1 else 0.2 / self.section * above

    def value_at(self, rank: float, ordered: tuple[np.ndarray, np.ndarray] | None = None) -> float:
        """The smallest kept value whose estimated rank is at least ``rank`` (1 to n)."""
        if rank <= 1:
            return self.least
        if rank >= self.n:
            return self.most
        items, ranks = ordered or self._sorted()
        return float(items[min(len(items) - 1, int(np.searchsorted(ranks, rank, "left")))])

    def quantile(self, percent: float, deviations: float = 0.0) -> tuple[float, float, float]:
        """Lower bound, estimate, upper bound of the smallest value with at least ``percent`` % of all not above it. Empty: NaN."""
        return self.quantiles([percent], deviations)[0]

    def quantiles(self, percents: Sequence[float], deviations: float = 0.0) -> list[tuple[float, float, float]]:
        """:meth:`quantile` of several percents, sorting once."""
        if not self.n:
            return [(math.nan, math.nan, math.nan)] * len(percents)
        ordered, out = self._sorted(), []
        for percent in percents:
            rank = max(1, math.ceil(percent * self.n / 100))
            wide = 0 if len(self.levels) == 1 else deviations * self.error(self.n - rank) + 1
            out.append(tuple(self.value_at(r, ordered) for r in (math.floor(rank - wide), rank, math.ceil(rank + wide))))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<HqddH", self.section, self.n, self.least, self.most, len(self.levels))
        return head + b"".join(struct.pack("<Iq", len(x), c) + x.astype("<f8").tobytes() for x, c in zip(self.levels, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        section, n, least, most, levels = struct.unpack_from("<HqddH", data)
        out, at = cls(section), struct.calcsize("<HqddH")
        out.n, out.least, out.most, out.levels, out.counts = n, least, most, [], []
        for _ in range(levels):
            size, count = struct.unpack_from("<Iq", data, at)
            at += struct.calcsize("<Iq")
            out.levels.append(np.frombuffer(data, "<f8", size, at).copy())
            out.counts.append(count)
            at += 8 * size
        return out
