"""Discrete transport by the network simplex: a spanning tree of the bipartite graph, improved one arc at a time."""

from __future__ import annotations

import numpy as np


def first_tree(supply: np.ndarray, demand: np.ndarray) -> dict[tuple[int, int], float]:
    """Flows of the north-west corner's tree: one arc less than there are nodes, some of them empty."""
    left, need = supply.astype(float).copy(), demand.astype(float).copy()
    flow, i, j = {}, 0, 0
    while True:
        move = min(left[i], need[j])
        flow[i, j] = move
        left[i] -= move
        need[j] -= move
        if i == len(left) - 1 and j == len(need) - 1:
            return flow
        if j == len(need) - 1 or i < len(left) - 1 and left[i] <= need[j]:
            i += 1
        else:
            j += 1


class _Tree:
    """The basis as a tree that hangs from source 0; nodes are sources, then sinks."""

    def __init__(self, n: int, m: int, flow: dict[tuple[int, int], float]) -> None:
        self.n, self.flow = n, flow
        self.near: list[set[int]] = [set() for _ in range(n + m)]
        for i, j in flow:
            self.near[i].add(n + j)
            self.near[n + j].add(i)

    def hang(self, cost: np.ndarray) -> np.ndarray:
        """Parents and depths anew; potentials so that the tree's arcs have no reduced cost."""
        size = len(self.near)
        self.parent, self.depth, price = [-1] * size, [0] * size, np.zeros(size)
        todo = [0]
        for x in todo:
            for y in self.near[x]:
                if y != self.parent[x]:
                    self.parent[y], self.depth[y] = x, self.depth[x] + 1
                    price[y] = (cost[x, y - self.n] if x < self.n else cost[y, x - self.n]) - price[x]
                    todo.append(y)
        return price

    def path(self, a: int, b: int) -> list[int]:
        """The tree's nodes from a to b."""
        up, down = [a], [b]
        while up[-1] != down[-1]:
            side = up if self.depth[up[-1]] >= self.depth[down[-1]] else down
            side.append(self.parent[side[-1]])
        return up + down[-2::-1]

    def arc(self, x: int, y: int) -> tuple[int, int]:
        return (x, y - self.n) if x < self.n else (y, x - self.n)


def network_simplex(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving ``supply`` to ``demand`` (of equal sums).

    The arc of the most negative reduced cost enters; after many steps without any move the first one by its number
    enters and leaves, which ends each standstill.
    """
    n, m = cost.shape
    tree = _Tree(n, m, first_tree(supply, demand))
    still, eps = 0, 1e-12 * max(1.0, float(cost.max(initial=0)))
    for _ in range(100 * n * m + 1000):
        price = tree.hang(cost)
        reduced = cost - price[:n, None] - price[n:]
        if still > 2 * (n + m):  # by number
            low = np.flatnonzero(reduced.ravel() < -eps)
            enter = int(low[0]) if len(low) else -1
        else:
            enter = int(reduced.argmin())
            enter = enter if reduced.flat[enter] < -eps else -1
        if enter < 0:
            return float(sum(f * cost[a] for a, f in tree.flow.items()))
        i, j = divmod(enter, m)
        nodes = tree.path(n + j, i)
        arcs = [tree.arc(x, y) for x, y in zip(nodes, nodes[1:], strict=False)]  # from the sink back: less, more, less, ...
        less = arcs[::2]
        move = max(min(tree.flow[a] for a in less), 0.0)
        leave = min(a for a in less if tree.flow[a] <= move)
        for k, a in enumerate(arcs):
            tree.flow[a] += move if k % 2 else -move
        del tree.flow[leave]
        tree.flow[i, j] = move
        x, y = leave[0], n + leave[1]
        tree.near[x].discard(y)
        tree.near[y].discard(x)
        tree.near[i].add(n + j)
        tree.near[n + j].add(i)
        still = still + 1 if move <= 0 else 0
    raise ArithmeticError("the network simplex did not settle")
