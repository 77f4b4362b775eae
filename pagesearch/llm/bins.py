"""Bin packing of counted lengths by linear grouping, configurations and best fit, a plan of bounded size."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np

LARGE = (1 / 8, 1 / 3, 1 / 2)   # of the capacity: longer items are grouped, shorter ones best-fitted; the best of these counts
GROUPS = 24                     # groups of equal cardinality, each rounded up to its longest item


@dataclass
class Run:
    """``count`` sequences with the same lengths in the same places; ``items`` holds (length, first rank, offset)."""

    count: int
    used: int = 0
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, count: int) -> Run:
        """Take ``count`` sequences off the front."""
        front = Run(count, self.used, list(self.items))
        self.count -= count
        self.items = [(length, rank + count, offset) for length, rank, offset in self.items]
        return front

    def put(self, length: int, rank: int) -> None:
        self.items.append((length, rank, self.used))
        self.used += length


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken (any number of times) for the greatest value within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gains = best[room - sizes[fits]] + values[fits]
        k = int(np.argmax(gains))
        if gains[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = gains[k], fits[k]
        else:
            best[room] = best[room - 1]
    taken, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            taken[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over a few sizes and how often each is used: the configuration program by column generation, rounded down."""
    basis = np.diag(np.floor(capacity / sizes))
    for _ in range(60 * len(sizes)):
        try:
            prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
            column = _knapsack(np.maximum(prices, 0), sizes, capacity)
            if prices @ column <= 1 + 1e-7:
                break
            amounts, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        except np.linalg.LinAlgError:
            break
        ratios = np.where(change > 1e-9, np.maximum(amounts, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = column
    amounts = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-7)
    left, used = demand.astype(np.int64).copy(), []
    for k, times in enumerate(amounts):
        pattern = basis[:, k].astype(np.int64)
        fits = np.flatnonzero(pattern)
        most = int(min([times, *(left[fits] // pattern[fits])])) if len(fits) else 0
        if most > 0:
            left -= pattern * most
            used.append((pattern, most))
    return used


class _Stock:
    """The items of one group, longest first, as (length, count, first rank)."""

    def __init__(self, counted: list[tuple[int, int, int]]):
        self.runs = [list(x) for x in counted]

    def take(self, most: int) -> tuple[int, int, int]:
        length, count, rank = self.runs[0]
        n = min(most, count)
        self.runs[0][1] -= n
        self.runs[0][2] += n
        if self.runs[0][1] == 0:
            del self.runs[0]
        return length, n, rank


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs of sequences that hold ``histogram[length]`` items of each length, ranked from 0 within their length.

    Work and result depend on the number of lengths, not on the number of items.
    """
    return min((_plan(histogram, capacity, share) for share in LARGE), key=lambda runs: sum(r.count for r in runs))


def _plan(histogram: dict[int, int], capacity: int, share: float) -> list[Run]:
    runs: list[Run] = []
    small = {n: [c, 0] for n, c in histogram.items() if n <= share * capacity}
    large = sorted(((n, c) for n, c in histogram.items() if n > share * capacity), reverse=True)
    # linear grouping: the long items, longest first, in groups of equal cardinality (cut within a length where needed)
    per_group = max(1, -(-sum(c for _, c in large) // GROUPS))
    groups: list[list[tuple[int, int, int]]] = []
    room = 0
    for length, count in large:
        rank = 0
        while rank < count:
            if room == 0:
                groups.append([])
                room = per_group
            n = min(room, count - rank)
            groups[-1].append((length, n, rank))
            rank, room = rank + n, room - n
    stocks = [_Stock(g) for g in groups]
    if groups:
        sizes = np.array([g[0][0] for g in groups])
        demand = np.array([sum(n for _, n, _ in g) for g in groups], dtype=float)
        kept, first = np.unique(sizes, return_index=True)  # groups rounded up to one size are one size of the program
        of = [np.flatnonzero(sizes == size) for size in kept]
        total = np.array([demand[members].sum() for members in of])
        for pattern, times in configurations(kept, total, capacity):
            # substitute actual items: sequences of the pattern in runs within which every slot keeps its length
            slots = [k for k in np.flatnonzero(pattern)[::-1] for _ in range(int(pattern[k]))]
            pending = [Run(times)]
            for slot in slots:
                filled = []
                for run in pending:
                    while run is not None:
                        stock = next(stocks[g] for g in of[slot] if stocks[g].runs)
                        length, n, rank = stock.take(run.count)
                        part = run if n == run.count else run.split(n)
                        run = None if part is run else run
                        part.put(length, rank)
                        filled.append(part)
                pending = filled
            runs += pending
    # what the rounding left over, then the short items, longest first, each to the fullest sequence that fits
    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def file(run: Run) -> None:
        left = capacity - run.used
        if left not in by_room:
            by_room[left] = []
            bisect.insort(rooms, left)
        by_room[left].append(run)

    for run in runs:
        file(run)
    rest: dict[int, list[list[int]]] = {}
    for stock in stocks:
        for length, count, rank in stock.runs:
            rest.setdefault(length, []).append([count, rank])
    for length, (count, rank) in small.items():
        rest.setdefault(length, []).append([count, rank])
    for length in sorted(rest, reverse=True):
        for count, rank in rest[length]:
            while count:
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    each = capacity // length
                    run = Run(max(1, count // each))
                    for _ in range(min(each, count)):
                        run.put(length, rank)
                        rank, count = rank + run.count, count - run.count
                    runs.append(run)
                    file(run)
                    continue
                left = rooms[at]
                run = by_room[left].pop()
                if not by_room[left]:
                    del by_room[left], rooms[at]
                if run.count > count:
                    part = run.split(count)
                    runs.append(part)
                    file(run)
                    run = part
                run.put(length, rank)
                rank, count = rank + run.count, count - run.count
                file(run)
    return runs
