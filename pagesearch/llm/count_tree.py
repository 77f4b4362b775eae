"""A count-vector R-tree over sets, joined with itself inside one bounded block of sets."""

from __future__ import annotations

import numpy as np

GROUPS = 64
LEAF = 32


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    """How many members of each set fall into each of the hash groups."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) % np.uint64(GROUPS)).astype(np.int64)
    return np.bincount(owner * GROUPS + group, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS).astype(np.int32)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of its component's root under links of Jaccard >= percent/100.

    ``sets`` are sorted arrays without repeats. Leaves of LEAF sets, tiled by size and then by counts,
    keep their largest count per group; two leaves, and then two sets, can only link when the summed
    coordinate minima reach the overlap that their sizes need. What is left is verified on the sets,
    unless both are in one component already: any further link would change nothing.
    """
    m = len(sets)
    parent = np.arange(m)
    if m < 2:
        return parent
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    vectors = count_vectors(sets)
    slices = np.empty(m, dtype=np.int64)
    slices[np.argsort(sizes, kind="stable")] = np.arange(m) // (8 * LEAF)
    order = np.lexsort((vectors[:, 1], vectors[:, 0] // 4, slices))
    starts = np.arange(0, m, LEAF)
    tiled, tiled_sizes = vectors[order], sizes[order]
    high = np.maximum.reduceat(tiled, starts, axis=0)
    low_size, high_size = np.minimum.reduceat(tiled_sizes, starts), np.maximum.reduceat(tiled_sizes, starts)

    def needed(total):  # the least overlap of two sets whose sizes sum to total
        return -(-percent * total // (100 + percent))

    for i in range(len(starts)):
        bound = np.minimum(high[i], high[i:]).sum(axis=1)
        near = (bound >= needed(low_size[i] + low_size[i:])) & (100 * high_size[i:] >= percent * low_size[i]) \
            & (100 * high_size[i] >= percent * low_size[i:])
        mine = order[starts[i]:starts[i] + LEAF]
        for j in np.flatnonzero(near) + i:
            others = order[starts[j]:starts[j] + LEAF]
            overlap = np.minimum(vectors[mine][:, None, :], vectors[others][None, :, :]).sum(axis=2)
            passed = overlap >= needed(sizes[mine][:, None] + sizes[others][None, :])
            if i == j:
                passed = np.triu(passed, 1)
            for a, b in zip(*np.nonzero(passed), strict=True):
                x, y = mine[a], others[b]
                root_x, root_y = _find(parent, x), _find(parent, y)
                if root_x == root_y:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                    parent[max(root_x, root_y)] = min(root_x, root_y)
    return np.array([_find(parent, x) for x in range(m)])
