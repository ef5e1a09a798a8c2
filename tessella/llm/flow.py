"""Minimum-cost flow on small networks with integer capacities and real costs."""

from __future__ import annotations

from heapq import heappop, heappush


class Network:
    """Arcs are added with capacity and cost; solve() sends up to a given flow from source to sink at least cost."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: float) -> int:
        """An arc from a to b; its number, for flow()."""
        n = len(self.to)
        self.to += [b, a]
        self.left += [max(0, int(capacity)), 0]
        self.cost += [cost, -cost]
        self.out[a].append(n)
        self.out[b].append(n + 1)
        return n

    def flow(self, arc: int) -> int:
        return self.left[arc + 1]

    def solve(self, source: int, sink: int, wanted: int) -> int:
        """Flow sent: shortest augmenting paths with potentials; costs may be negative, cycles of negative cost may not exist."""
        n = len(self.out)
        far = float("inf")
        height = [0.0] * n
        for _ in range(n):  # Bellman-Ford for the first potentials
            changed = False
            for a in range(n):
                for e in self.out[a]:
                    if self.left[e] and height[a] + self.cost[e] < height[self.to[e]] - 1e-12:
                        height[self.to[e]] = height[a] + self.cost[e]
                        changed = True
            if not changed:
                break
        sent = 0
        while sent < wanted:
            dist, came = [far] * n, [-1] * n
            dist[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, a = heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    if self.left[e]:
                        b = self.to[e]
                        there = d + max(0.0, self.cost[e] + height[a] - height[b])
                        if there < dist[b] - 1e-12:
                            dist[b], came[b] = there, e
                            heappush(heap, (there, b))
            if dist[sink] == far:
                break
            for a in range(n):
                if dist[a] < far:
                    height[a] += dist[a]
            push, b = wanted - sent, sink
            while b != source:
                push = min(push, self.left[came[b]])
                b = self.to[came[b] ^ 1]
            b = sink
            while b != source:
                self.left[came[b]] -= push
                self.left[came[b] ^ 1] += push
                b = self.to[came[b] ^ 1]
            sent += push
        return sent

    def cheapest_path(self, a: int, b: int, closed: set[int]) -> list[int] | None:
        """Arcs with room from a to b, none of them closed, at least cost; costs may be negative, cycles of negative cost are not followed."""
        dist, came = {a: 0.0}, {a: ()}
        for _ in range(len(self.out)):
            changed = False
            for x in list(dist):
                for e in self.out[x]:
                    y = self.to[e]
                    if self.left[e] > 0 and e not in closed and dist[x] + self.cost[e] < dist.get(y, float("inf")) - 1e-9:
                        if any(self.to[p] == y for p in came[x]) or y == a:
                            continue
                        dist[y], came[y], changed = dist[x] + self.cost[e], (*came[x], e), True
            if not changed:
                break
        return list(came[b]) if b in came else None
