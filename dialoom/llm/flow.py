"""Exact minimum-cost flow with convex costs, for quotas.

Every arc has a convex piecewise-linear cost, given as pieces (units, cost of each unit) of rising cost, so a piece is
a parallel arc of the residual network: forward at its cost, backward at minus that cost. Shortest distances come from
a vectorised Bellman-Ford over all residual arcs (potentials make later rounds start near their end); then everything
that shortest paths can carry is sent by blocking flows, each path by its bottleneck. The number of rounds is bounded
by the number of different path costs, so it doesn't grow with the units: pieces grow geometrically.
"""

from __future__ import annotations

from collections import deque

import numpy as np

FAR = np.iinfo(np.int64).max // 4


def pieces(target: int, capacity: int, weight: int, cover: int = 0) -> list[tuple[int, int]]:
    """The cost of filling a node: nothing up to its target, then convex, in pieces that double in width.

    ``cover``: what every unit but the first costs besides.
    """
    out, left, step = [], capacity, 0
    for width in ([1, target - 1] if cover else [target]):
        n = min(left, width)
        if n > 0:
            out.append((n, cover if out else 0))
            left -= n
    width = max(1, target // 8)
    while left > 0:
        step += 1
        n = min(left, width)
        out.append((n, (cover if out else 0) + weight * step * step))
        left, width = left - n, width * 2
    return out


class Flow:
    """Units from ``source`` to ``sink`` at the least cost. Nodes are numbers below ``nodes``."""

    def __init__(self, nodes: int, source: int, sink: int) -> None:
        self.nodes, self.source, self.sink = nodes, source, sink
        self.tails: list[int] = []
        self.heads: list[int] = []
        self.costs: list[int] = []
        self.rooms: list[int] = []
        self.owners: list[int] = []
        self.arcs = 0

    def add(self, tail: int, head: int, cost: list[tuple[int, int]]) -> int:
        """An arc with its pieces; returns its number."""
        for units, each in cost:
            if units > 0:
                self.tails += [tail, head]
                self.heads += [head, tail]
                self.costs += [each, -each]
                self.rooms += [units, 0]
                self.owners.append(self.arcs)
        self.arcs += 1
        return self.arcs - 1

    def solve(self, size: int) -> tuple[list[int], int, int]:
        """(units on each arc, units placed, total cost): ``size`` units, or as many as there is room for."""
        tail, head, cost, room = (np.array(x, dtype=np.int64) for x in (self.tails, self.heads, self.costs, self.rooms))
        out_of: list[list[int]] = [[] for _ in range(self.nodes)]
        for i, t in enumerate(self.tails):
            out_of[t].append(i)
        heads = self.heads
        placed, potential = 0, np.zeros(self.nodes, dtype=np.int64)
        while placed < size:
            dist = self._distances(tail, head, cost + potential[tail] - potential[head], room)
            if dist[self.sink] >= FAR:
                break
            potential = potential + np.minimum(dist, dist[dist < FAR].max())
            tight = ((room > 0) | (room[np.arange(len(room)) ^ 1] > 0)) & (cost + potential[tail] - potential[head] == 0)
            placed += self._send(out_of, heads, room, tight.tolist(), size - placed)
        back = room[1::2]
        used = np.bincount(np.array(self.owners, dtype=np.int64), weights=back, minlength=self.arcs).astype(np.int64) if self.arcs else np.zeros(0, np.int64)
        return used.tolist(), placed, int((back * cost[::2]).sum()) if len(cost) else 0

    def _distances(self, tail: np.ndarray, head: np.ndarray, cost: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Shortest distances from the source over arcs with room; only arcs whose tail got nearer are looked at."""
        usable = np.flatnonzero(room > 0)
        t, h, c = tail[usable], head[usable], cost[usable]
        order = np.argsort(t, kind="stable")
        t, h, c = t[order], h[order], c[order]
        dist = np.full(self.nodes, FAR, dtype=np.int64)
        dist[self.source] = 0
        moved = np.zeros(self.nodes, dtype=bool)
        moved[self.source] = True
        while moved.any():
            now = np.flatnonzero(moved[t])
            if not len(now):
                break
            before = dist.copy()
            np.minimum.at(dist, h[now], dist[t[now]] + c[now])
            moved = dist < before
        return dist

    def _send(self, out_of: list[list[int]], heads: list[int], room: np.ndarray, tight: list[bool], size: int) -> int:
        """Blocking flows over tight arcs until none is left; returns the units sent."""
        left, sent = room.tolist(), 0
        while sent < size:
            level = [-1] * self.nodes
            level[self.source] = 0
            queue = deque([self.source])
            while queue and level[self.sink] < 0:
                v = queue.popleft()
                for i in out_of[v]:
                    if tight[i] and left[i] > 0 and level[heads[i]] < 0:
                        level[heads[i]] = level[v] + 1
                        queue.append(heads[i])
            if level[self.sink] < 0:
                break
            at, path, v = [0] * self.nodes, [], self.source
            while True:
                if v == self.sink:
                    n = min(size - sent, *[left[i] for i in path])
                    for i in path:
                        left[i] -= n
                        left[i ^ 1] += n
                    sent += n
                    if sent == size:
                        break
                    cut = next(k for k, i in enumerate(path) if left[i] == 0)
                    v, path = heads[path[cut] ^ 1], path[:cut]
                    continue
                arcs = out_of[v]
                while at[v] < len(arcs):
                    i = arcs[at[v]]
                    if tight[i] and left[i] > 0 and level[heads[i]] == level[v] + 1:
                        break
                    at[v] += 1
                if at[v] < len(arcs):
                    path.append(arcs[at[v]])
                    v = heads[arcs[at[v]]]
                elif path:
                    i = path.pop()
                    v = heads[i ^ 1]
                    at[v] += 1
                else:
                    break
        room[:] = left
        return sent
