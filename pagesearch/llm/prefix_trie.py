"""Nearest codebook entries of many short integer vectors, by a walk over the trie of their prefixes."""

from __future__ import annotations

import numpy as np

LEAVES = 8_192      # a subtree up to this size is finished at once


def _level_by_level(parts: np.ndarray, entries: np.ndarray, depth: int, sums: np.ndarray) -> np.ndarray:
    """Distances of every leaf to all entries; a node's distance vector is computed once for all leaves below it."""
    held = sums[None, :]                        # a row per node of the level above
    node = np.zeros(len(parts), dtype=np.int64)  # the node of that level over each leaf
    opens = np.zeros(len(parts), dtype=bool)    # leaves that start a node of the level
    opens[:1] = True
    for place in range(depth, parts.shape[1]):
        column = parts[:, place]
        opens[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(opens)
        held = held[node[starts]] + np.square(column[starts, None] - entries[None, :, place])
        node = np.cumsum(opens) - 1
    return held[node]


def nearest(parts: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the index of its nearest entry (ties: the lower index) and the squared distance.

    ``parts`` is an int64 matrix whose rows are sorted lexicographically, so the leaves of a trie node stand
    in one run. The walk goes depth first over nodes with more than ``leaves`` leaves and carries the sums of
    squared differences of the prefix to all entries along; runs of smaller siblings are finished in one go
    from the vector of their parent, so no more than ``leaves`` distance vectors are held at a time.
    """
    best, distance = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    pending = [(0, len(parts), 0, np.zeros(len(entries), dtype=np.int64))]
    while pending:
        low, high, depth, sums = pending.pop()
        if depth == parts.shape[1]:     # equal rows
            best[low:high], distance[low:high] = sums.argmin(), sums.min()
            continue
        if high - low <= leaves:
            held = _level_by_level(parts[low:high], entries, depth, sums)
            best[low:high], distance[low:high] = held.argmin(axis=1), held.min(axis=1)
            continue
        column = parts[low:high, depth]
        starts = low + np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        ends = np.r_[starts[1:], high]
        first = 0
        while first < len(starts):
            last = max(int(np.searchsorted(ends, starts[first] + leaves, side="right")), first + 1)
            if ends[first] - starts[first] > leaves:
                step = np.square(parts[starts[first], depth] - entries[:, depth])
                pending.append((starts[first], ends[first], depth + 1, sums + step))
            else:
                pending.append((starts[first], ends[last - 1], depth, sums))
            first = last
    return best, distance
