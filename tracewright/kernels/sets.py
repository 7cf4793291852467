"""Disjoint sets and matchings of small graphs."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np


class Sets:
    """Disjoint sets of 0..n-1; a set is named by its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def groups(self) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for x in range(len(self.up)):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def cheapest_matching(pairs: Iterable[tuple[int, int, tuple[float, ...]]], rows: int, columns: int) -> list[tuple[int, int]]:
    """Of the largest matchings of rows and columns the one with the least sum of costs, compared term by term.

    By shortest augmenting paths with potentials over a dense table: terms are weighed so that each outweighs all sums of the next, and a pair
    that is none outweighs all.
    """
    listed = [(r, c, cost) for r, c, cost in pairs]
    if not listed:
        return []
    size = min(rows, columns)
    terms = len(listed[0][2])
    weights, scale = [0.0] * terms, 1.0
    for k in range(terms - 1, -1, -1):
        weights[k] = scale
        most = max(cost[k] for _, _, cost in listed)
        scale *= (size + 1) * max(1.0, most)
    price = np.full((rows, columns), scale * (size + 1))
    for r, c, cost in listed:
        price[r, c] = min(price[r, c], sum(w * x for w, x in zip(weights, cost, strict=True)))
    turned = rows > columns
    table = price.T if turned else price
    n, m = table.shape
    row_of = np.full(m + 1, -1)
    u, v = np.zeros(n), np.zeros(m + 1)
    for row in range(n):
        row_of[m] = row
        at, least, came, done = m, np.full(m, math.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[at] >= 0:
            done[at] = True
            i = row_of[at]
            reduced = table[i] - u[i] - v[:m]
            better = ~done[:m] & (reduced < least)
            least[better], came[better] = reduced[better], at
            free = np.flatnonzero(~done[:m])
            step_to = free[np.argmin(least[free])]
            step = least[step_to]
            u[row_of[np.flatnonzero(done)]] += step
            v[done] -= step
            least[~done[:m]] -= step
            at = int(step_to)
        while at != m:
            row_of[at], at = row_of[came[at]], int(came[at])
    known = {(r, c) for r, c, _ in listed}
    chosen = [(int(row_of[c]), c) for c in range(m) if row_of[c] >= 0]
    return sorted((c, r) if turned else (r, c) for r, c in chosen if ((c, r) if turned else (r, c)) in known)
