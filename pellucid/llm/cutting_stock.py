"""Cutting stock by column generation: how many sequences to fill by which pattern of piece widths.

The linear program asks for the least number of sequences whose patterns cover a histogram of widths. Its columns,
the patterns, are made on demand: the program's dual values price each width, and a knapsack finds the pattern of
greatest price that fits a sequence. When none is worth more than a sequence, the program is solved; patterns are
then taken whole times, and what rounding leaves is filled largest first. All of it depends on the number of
widths, not on the number of pieces.
"""

from __future__ import annotations

import numpy as np


def width_classes(capacity: int, exact: int = 64, steps: int = 32) -> np.ndarray:
    """Ascending widths that lengths are rounded up to: each length up to ``exact``, then ``steps`` in each doubling."""
    widths, at = list(range(1, min(exact, capacity) + 1)), exact
    while at < capacity:
        widths += [min(capacity, at + -(-at * k // steps)) for k in range(1, steps + 1)]
        at *= 2
    return np.array(sorted(set(widths)), dtype=np.int64)


def best_patterns(widths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns as columns, how often each takes each width: the one of greatest price that fits (an unbounded
    knapsack), and for each width the one of greatest price among those that take it.
    """
    best = np.zeros(capacity + 1)
    tables = [best]
    for w, price in zip(widths, prices, strict=True):
        if price > 1e-12:
            # along each residue of w, taking k more pieces adds k prices: a running maximum
            rows = capacity // w + 1
            padded = np.full(rows * w, -np.inf)
            padded[: min(rows * w, capacity + 1)] = best[: rows * w]
            gain = price * np.arange(rows)[:, None]
            best = np.maximum(best, np.pad((np.maximum.accumulate(padded.reshape(rows, w) - gain, axis=0) + gain).ravel(), (0, w))[: capacity + 1])
        tables.append(best)
    taken, room = np.zeros((len(widths), len(widths) + 1), dtype=np.int64), np.full(len(widths) + 1, capacity)
    taken[range(len(widths)), range(1, len(widths) + 1)] = 1
    room[1:] -= widths
    for k in range(len(widths) - 1, -1, -1):
        while (more := tables[k + 1][room] > tables[k][room] + 1e-15).any():
            taken[k, more] += 1
            room[more] -= widths[k]
    return taken


def _largest_first(widths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    taken, room = np.zeros(len(widths), dtype=np.int64), capacity
    for k in np.nonzero(left)[0][::-1]:
        taken[k] = min(left[k], room // widths[k])
        room -= taken[k] * widths[k]
    return taken


def _greedy(widths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that use up all pieces, largest first."""
    left, found = left.copy(), []
    while left.any():
        pattern = _largest_first(widths, left, capacity)
        inside = pattern > 0
        times = int((left[inside] // pattern[inside]).min())
        found.append((pattern, times))
        left -= pattern * times
    return found


class _Master:
    """The linear program over the patterns known so far, solved by the revised simplex method."""

    def __init__(self, widths: np.ndarray, counts: np.ndarray, capacity: int):
        self.counts = counts
        self.basis = np.diag(capacity // widths).astype(float)
        self.known = np.zeros((len(widths), 0))
        self.turn = 0
        self._factor()

    def _factor(self) -> None:
        self.inverse = np.linalg.inv(self.basis)
        self.amounts = np.maximum(self.inverse @ self.counts, 0.0)

    @property
    def prices(self) -> np.ndarray:
        return self.inverse.sum(axis=0)

    def add(self, patterns: np.ndarray) -> None:
        self.known = np.unique(np.hstack([self.known, patterns]), axis=1)

    def solve(self) -> None:
        """Exchange patterns until no known one is worth more than a sequence."""
        for _ in range(20 * len(self.counts)):
            worth = self.prices @ self.known
            entering = self.known[:, int(np.argmax(worth))]
            if worth.max() <= 1 + 1e-9:
                break
            direction = self.inverse @ entering
            limits = np.full(len(direction), np.inf)
            np.divide(self.amounts, direction, out=limits, where=direction > 1e-6)
            # among equals the largest pivot, so that the basis stays well conditioned
            leaving = int(np.argmax(np.where(limits <= limits.min() + 1e-9, direction, -1.0)))
            self.basis[:, leaving] = entering
            row = self.inverse[leaving] / direction[leaving]
            self.inverse -= np.outer(direction, row)
            self.inverse[leaving] = row
            self.amounts = np.maximum(self.inverse @ self.counts, 0.0)
            self.turn += 1
            if self.turn % 100 == 0:
                self._factor()
        self._factor()


def solve_relaxed(widths: np.ndarray, counts: np.ndarray, capacity: int, tolerance: float = 2e-3, most_rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each), fractions allowed; within ``tolerance`` of the least number of sequences.

    The search starts from the largest-first patterns. It ends earlier after ``most_rounds`` pricings, with a
    solution that is as feasible but may be further from the least.
    """
    master = _Master(widths, counts.astype(float), capacity)
    master.add(np.stack([p for p, _ in _greedy(widths, counts.astype(np.int64), capacity)], axis=1))
    # no fewer than the pieces' total fills; prices, scaled to be feasible, may raise this bound
    bound = widths @ counts / capacity
    for _ in range(most_rounds):
        master.solve()
        found = best_patterns(widths, master.prices, capacity)
        value = master.prices @ found[:, 0]
        bound = max(bound, master.prices @ counts / value)
        if value <= 1 + 1e-9 or master.amounts.sum() <= (1 + tolerance) * bound:
            break
        master.add(found)
    return master.basis.astype(np.int64), master.amounts


def packing_patterns(widths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): whole numbers of sequences that take exactly ``counts`` pieces of each width."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.nonzero(counts)[0]
    if not len(used):
        return []
    w, left = widths[used], counts[used].copy()
    patterns, amounts = solve_relaxed(w, left, capacity)
    found = []
    for k in np.argsort(-amounts, kind="stable"):
        pattern = patterns[:, k]
        inside = pattern > 0
        times = min(int(amounts[k] + 1e-6), int((left[inside] // pattern[inside]).min()))
        if times > 0:
            found.append((pattern, times))
            left -= pattern * times
    out = []
    found += _greedy(w, left, capacity)
    for pattern, times in found:
        whole = np.zeros(len(widths), dtype=np.int64)
        whole[used] = pattern
        out.append((whole, times))
    return out
