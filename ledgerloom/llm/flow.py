"""Minimum-cost flow on a small graph (successive shortest paths)."""

from __future__ import annotations

import heapq


class MinCostFlow:
    """Integer capacities and costs; costs may not be negative.

    The graphs built here have one node for each source, pattern or shard, never
    one for each document, so they fit on the driver.
    """

    def __init__(self, n: int):
        self.n = n
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        """Add an arc and return its number, for ``flow``."""
        k = len(self.to)
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.at[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def flow(self, k: int) -> int:
        return self.cap[k ^ 1]

    def solve(self, s: int, t: int) -> tuple[int, int]:
        """Greatest flow from s to t at least cost: (flow, cost)."""
        total = paid = 0
        rank = [0] * self.n
        while True:
            far = [None] * self.n
            via = [-1] * self.n
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for k in self.at[u]:
                    if self.cap[k] > 0:
                        v = self.to[k]
                        e = d + self.cost[k] + rank[u] - rank[v]
                        if far[v] is None or e < far[v]:
                            far[v] = e
                            via[v] = k
                            heapq.heappush(heap, (e, v))
            if far[t] is None:
                return total, paid
            for v in range(self.n):
                rank[v] += far[v] if far[v] is not None else far[t]
            push, v = None, t
            while v != s:
                push = self.cap[via[v]] if push is None else min(push, self.cap[via[v]])
                v = self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= push
                self.cap[via[v] ^ 1] += push
                paid += push * self.cost[via[v]]
                v = self.to[via[v] ^ 1]
            total += push
