"""First-fit packing over an index of open batches.

The first batch that takes a row is found without trying the batches before it.  A tree over the batches, in the order they were
opened, keeps for each range the largest and smallest differences of lengths that one of its batches with room can take; each key
knows the batches that hold it and leads past them.  Only a batch that both leave is tried, with the exact bounds.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

#: Bounds are told at six decimals; the tree leaves that much room.
_SLACK = 1e-6


@dataclass
class Batch:
    """One open batch; lengths are kept sorted."""

    rows: list = field(default_factory=list)
    p_sizes: list = field(default_factory=list)
    n_sizes: list = field(default_factory=list)
    gap: int = 0

    def fits(self, p: int, n: int, mean: float, quantile: float) -> bool:
        """Whether mean and median lengths stay within their bounds with these two added."""

        def middle(sizes: list, extra: int) -> float:
            at, m = bisect_left(sizes, extra), len(sizes) + 1
            pick = lambda i: sizes[i] if i < at else extra if i == at else sizes[i - 1]
            return (pick((m - 1) // 2) + pick(m // 2)) / 2

        if round(abs(self.gap + p - n) / (len(self.rows) + 1), 6) > mean:
            return False
        return round(abs(middle(self.p_sizes, p) - middle(self.n_sizes, n)), 6) <= quantile


class Holders:
    """For each key the batches that hold it, as steps to the next one that does not."""

    def __init__(self) -> None:
        self.steps: dict[str, dict[int, int]] = {}

    def hold(self, key: str, batch: int) -> None:
        self.steps.setdefault(key, {})[batch] = batch + 1

    def without(self, key: str, batch: int) -> int:
        """The first batch from ``batch`` on that does not hold the key."""
        steps = self.steps.get(key)
        if not steps or batch not in steps:
            return batch
        path = []
        while batch in steps:
            path.append(batch)
            batch = steps[batch]
        for at in path:
            steps[at] = batch
        return batch


class Room:
    """The tree: for each range of batches the most and the least that a row's positive may be longer than its negative."""

    def __init__(self) -> None:
        self.size = 1
        self.most, self.least = [-float("inf")] * 2, [float("inf")] * 2

    def set(self, at: int, least: float, most: float) -> None:
        while at >= self.size:
            self._double()
        i = at + self.size
        self.most[i], self.least[i] = most, least
        while i > 1:
            i //= 2
            self.most[i], self.least[i] = max(self.most[2 * i], self.most[2 * i + 1]), min(self.least[2 * i], self.least[2 * i + 1])

    def _double(self) -> None:
        leaves = [(self.least[self.size + i], self.most[self.size + i]) for i in range(self.size)]
        self.size *= 2
        self.most, self.least = [-float("inf")] * 2 * self.size, [float("inf")] * 2 * self.size
        for i, (least, most) in enumerate(leaves):
            self.most[self.size + i], self.least[self.size + i] = most, least
        for i in range(self.size - 1, 0, -1):
            self.most[i], self.least[i] = max(self.most[2 * i], self.most[2 * i + 1]), min(self.least[2 * i], self.least[2 * i + 1])

    def first(self, start: int, gap: float) -> int | None:
        """The first batch from ``start`` on that can take this difference."""
        if start >= self.size:
            return None
        i = start + self.size
        while True:
            if self.most[i] >= gap and self.least[i] <= gap:
                if i >= self.size:
                    return i - self.size
                i *= 2
                continue
            while i % 2:  # up from right children, then to the right
                i //= 2
                if not i:
                    return None
            i += 1


class OpenBatches:
    """All batches in the order they were opened."""

    def __init__(self, batch_size: int, mean: float, quantile: float):
        self.batch_size, self.mean, self.quantile = batch_size, mean, quantile
        self.batches: list[Batch] = []
        self.positives, self.negatives, self.room = Holders(), Holders(), Room()

    def _put(self, at: int, row, key: str, p: int, choice: dict) -> None:
        batch, n = self.batches[at], len(choice["text"])
        batch.rows.append((row, choice))
        insort(batch.p_sizes, p)
        insort(batch.n_sizes, n)
        batch.gap += p - n
        self.positives.hold(key, at)
        self.negatives.hold(choice["key"], at)
        count = len(batch.rows) + 1
        full = count > self.batch_size
        reach = (self.mean + _SLACK) * count
        self.room.set(at, float("inf") if full else -reach - batch.gap, -float("inf") if full else reach - batch.gap)

    def _first(self, key: str, p: int, choice: dict, end: int) -> int | None:
        """The first batch before ``end`` that takes the row with this negative."""
        n, at = len(choice["text"]), 0
        while (at := self.room.first(at, p - n)) is not None and at < end:
            on = self.negatives.without(key, self.positives.without(key, self.positives.without(choice["key"], at)))
            if on != at:
                at = on
            elif self.batches[at].fits(p, n, self.mean, self.quantile):
                return at
            else:
                at += 1
        return None

    def add(self, row, key: str, p: int, choices: list[dict]) -> bool:
        """Puts the row into the first batch that takes it with one of ``choices``, the first of those that do, or into a new one."""
        best, chosen = len(self.batches), None
        for choice in choices:
            at = self._first(key, p, choice, best)
            if at is not None:
                best, chosen = at, choice
        if chosen is None:
            fresh = Batch()
            chosen = next((c for c in choices if fresh.fits(p, len(c["text"]), self.mean, self.quantile)), None)
            if chosen is None:
                return False
            self.batches.append(fresh)
        self._put(best, row, key, p, chosen)
        return True
