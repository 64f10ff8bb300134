"""Spanning forests of the pairs inside a bucket, in numpy: n members give at most n - 1 edges, not n^2 / 2 pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def spanning_forest(label: np.ndarray, allowed: Callable, alike: Callable, at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, labels): edges that connect what all alike pairs of members connect, and the members' labels after them.

    ``label``: members of equal labels count as connected from the start. ``allowed(i, j)`` says which
    pairs may count at all, ``alike(i, j)`` which of those are edges. Members are compared with all later ones
    row by row; pairs that edges before them connect are skipped, so a group of copies costs one row.
    """
    m = len(label)
    _, label = np.unique(label, return_inverse=True)
    left, right = [], []
    low, rows = 0, 1
    while low < m - 1 and (label[low:] != label[low]).any():
        high = min(m, low + rows)
        i, j = np.meshgrid(np.arange(low, high), np.arange(low, m), indexing="ij")
        ok = (i < j) & (label[i] != label[j])
        i, j = i[ok], j[ok]
        ok = allowed(i, j)
        i, j = i[ok], j[ok]
        ok = alike(i, j)
        i, j = i[ok], j[ok]
        while len(i):
            a, b = label[i], label[j]
            live = np.flatnonzero(a != b)
            i, j, a, b = i[live], j[live], a[live], b[live]
            if not len(i):
                break
            top, bottom = np.maximum(a, b), np.minimum(a, b)
            hook, first = np.unique(top, return_index=True)  # one edge for each label, to a lower one: no cycles
            left.append(i[first])
            right.append(j[first])
            parent = np.arange(max(int(label.max()), int(top.max())) + 1)
            parent[hook] = bottom[first]
            while (up := parent[parent]).tolist() != parent.tolist():
                parent = up
            label = parent[label]
        low, rows = high, max(1, min(rows * 2, at_once // m))
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none), label
