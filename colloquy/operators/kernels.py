"""Small exact numeric kernels: assignment, clustering, centroids, word errors."""

from __future__ import annotations

import numpy as np


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows; with a zero row 0 for equal rows, else 1."""
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1.0 - a @ b.T / size
    zero = size == 0
    if zero.any():
        out[zero] = (~(a[:, None, :] == b[None, :, :]).all(2))[zero]
    return out


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest one-to-one assignment (rows <= columns), the first such by columns.

    Costs of the best completion are found for every set of used columns, from the last row back.
    """
    rows, columns = cost.shape
    if rows > columns:
        back = assign(cost.T)
        out = np.full(rows, -1)
        out[back] = np.arange(columns)
        return out
    if columns > 12:
        return _augment(cost)
    best = {frozenset(): 0.0}
    levels = [best]
    for r in range(rows - 1, -1, -1):
        after: dict = {}
        for used, value in levels[-1].items():
            for c in range(columns):
                if c not in used:
                    key, total = used | {c}, value + cost[r, c]
                    if key not in after or total < after[key]:
                        after[key] = total
        levels.append(after)
    levels.reverse()  # levels[r]: cost of rows r.. using exactly a set of columns
    least = min(levels[0].values())
    left = {s for s, v in levels[0].items() if v <= least + 1e-9}
    out = np.empty(rows, dtype=int)
    for r in range(rows):  # the least column that some cheapest completion uses
        for c in range(columns):
            after = {s - {c} for s in left if c in s and abs(levels[r + 1].get(s - {c}, np.inf) + cost[r, c] - levels[r][s]) < 1e-9}
            if after:
                out[r], left = c, after
                break
    return out


def _augment(cost: np.ndarray) -> np.ndarray:
    """Shortest augmenting paths with potentials, for many columns."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0] = i
        j, way = 0, np.zeros(m + 1, dtype=int)
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            done[j] = True
            free = ~done
            free[0] = False
            slack = cost[match[j] - 1] - u[match[j]] - v[1:]
            closer = free[1:] & (slack < least[1:])
            least[1:][closer], way[1:][closer] = slack[closer], j
            k = int(np.where(free, least, np.inf).argmin())
            step = least[k]
            u[match[done]] += step
            v[done] -= step
            least[free] -= step
            j = k
            if not match[j]:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.empty(n, dtype=int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def average_link(distance: np.ndarray, *, clusters: int | None = None, limit: float | None = None) -> np.ndarray:
    """Labels by merging the two clusters with the least mean distance, the first such, until there
    are ``clusters`` of them or the next merge would pass ``limit``.  Labels follow the least member."""
    n = len(distance)
    members = [[i] for i in range(n)]
    total, size = np.array(distance, dtype=float), np.ones(n)
    while len(members) > (clusters or 1):
        mean = total / np.outer(size, size)
        mean[np.tril_indices(len(mean))] = np.inf
        i, j = divmod(int(mean.argmin()), len(mean))
        if not np.isfinite(mean[i, j]) or limit is not None and mean[i, j] > limit:
            break
        total[i] += total[j]
        total[:, i] += total[:, j]
        size[i] += size[j]
        members[i] += members.pop(j)
        total, size = np.delete(np.delete(total, j, 0), j, 1), np.delete(size, j)
    out = np.zeros(n, dtype=int)
    for label, m in enumerate(members):
        out[m] = label
    return out


def weighted_centroids(x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[int, np.ndarray]:
    return {int(k): np.average(x[labels == k], axis=0, weights=weights[labels == k]) for k in dict.fromkeys(labels.tolist())}


def word_errors(ref: list[str], hyp: list[str]) -> int:
    """Least substitutions, insertions and deletions; a row of the table is one vector step."""
    if not ref or not hyp:
        return max(len(ref), len(hyp))
    index: dict[str, int] = {}
    r, h = (np.array([index.setdefault(w, len(index)) for w in x]) for x in (ref, hyp))
    at = np.arange(len(h) + 1)
    row = at.copy()
    for k, w in enumerate(r, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (h != w))
        row = np.minimum.accumulate(np.r_[k, step] - at) + at
    return int(row[-1])
