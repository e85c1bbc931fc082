"""Matchings of most pairs, then least cost, over arrays of edges."""

from __future__ import annotations

import heapq

import numpy as np

#: A distance that no path has.
FAR = np.iinfo(np.int64).max


def _gather(start: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The places of all edges of nodes, whose edges lie from start[node] to start[node + 1]."""
    n = start[nodes + 1] - start[nodes]
    ends = np.cumsum(n)
    return np.repeat(start[nodes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class Matching:
    """Edges (a, b, cost), sorted by (a, b) and each there once, nodes numbered from 0 on either side, costs whole and 0 or more, their sum within 63 bits.

    The primal-dual method: one search from all free nodes of the left finds the
    length of the shortest augmenting path, and as many paths of that length as
    there are get taken by the phases of Hopcroft and Karp on the edges that are
    tight then. Searches run over arrays, so their number follows the number of
    lengths, not of nodes. What is chosen in one connected component never
    depends on others, so any number of them may be solved at once.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, cost: np.ndarray):
        self.a, self.b, self.cost = a, b, cost
        self.lefts, self.rights = (int(x.max()) + 1 if len(x) else 0 for x in (a, b))
        self.start = np.searchsorted(a, np.arange(self.lefts + 1))
        self.edge = np.full(self.lefts, -1)  # the edge taken at each node of the left
        self.mate = np.full(self.rights, -1)  # the node matched to each of the right
        self.at_a, self.at_b = np.zeros(self.lefts, np.int64), np.zeros(self.rights, np.int64)  # potentials: cost + at_a - at_b is 0 or more, 0 on what is taken
        self.far = 0  # the potential of free nodes of the right; that of free ones of the left is 0
        while self._search():
            tight = np.flatnonzero(self.cost + self.at_a[a] == self.at_b[b])
            start = np.searchsorted(a[tight], np.arange(self.lefts + 1))
            while self._augment(tight, start):
                pass

    def _search(self) -> bool:
        """Raise the potentials by the distances from the free nodes of the left, up to that of the nearest free one of the right; whether there is one."""
        to_a, to_b = np.full(self.lefts, FAR), np.full(self.rights, FAR)
        done = np.zeros(self.rights, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []
        nodes, d = np.flatnonzero(self.edge < 0), 0
        while True:
            to_a[nodes] = d
            e = _gather(self.start, nodes)
            y = self.b[e]
            reach = d + self.cost[e] + self.at_a[self.a[e]] - self.at_b[y]
            nearer = reach < to_b[y]
            y, reach = y[nearer], reach[nearer]
            np.minimum.at(to_b, y, reach)
            last = reach == to_b[y]
            y, reach = y[last], reach[last]
            if len(y):
                by = np.argsort(reach, kind="stable")
                y, reach = y[by], reach[by]
                cuts = np.flatnonzero(np.diff(reach)) + 1
                for k, some in zip(reach[np.r_[0, cuts]].tolist(), np.split(y, cuts)):
                    if k not in waiting:
                        waiting[k] = []
                        heapq.heappush(order, k)
                    waiting[k].append(some)
            while True:
                if not order:
                    return False
                d = heapq.heappop(order)
                found = waiting.pop(d)
                y = np.unique(np.concatenate(found) if len(found) > 1 else found[0])
                y = y[(to_b[y] == d) & ~done[y]]
                if len(y):
                    break
            done[y] = True
            nodes = self.mate[y]
            if (nodes < 0).any():
                break
        self.at_a += np.minimum(to_a, d)
        self.at_b += np.minimum(to_b, d)
        self.far += d
        return True

    def _augment(self, tight: np.ndarray, start: np.ndarray) -> bool:
        """Take shortest augmenting paths of tight edges, no two of which share a node, until each other one shares one; whether there were any."""
        heads, tails = self.a[tight], self.b[tight]
        seen = np.zeros(self.rights, bool)
        nodes, layers = np.flatnonzero(self.edge < 0), []
        while len(nodes):
            e = _gather(start, nodes)
            e = e[~seen[tails[e]]]
            layers.append(e)
            y = np.unique(tails[e])
            seen[y] = True
            nodes = np.sort(self.mate[y])
            if len(nodes) and nodes[0] < 0:
                break
        else:
            return False
        useful = np.zeros(self.lefts + 1, bool)  # the last place stands for no mate
        useful[-1] = True
        for k in range(len(layers) - 1, -1, -1):
            layers[k] = layers[k][useful[self.mate[tails[layers[k]]]]]
            useful[-1] = False
            useful[heads[layers[k]]] = True
        e = np.concatenate(layers)
        x, to, then = heads[e], tails[e].tolist(), self.mate[tails[e]].tolist()
        cuts = np.flatnonzero(np.diff(x)) + 1
        firsts = np.r_[0, cuts]
        at, end = dict(zip(x[firsts].tolist(), firsts.tolist())), dict(zip(x[firsts].tolist(), [*cuts.tolist(), len(x)]))
        used, taken = set(), []
        for root in np.unique(heads[layers[0]]).tolist():
            path, steps = [root], []
            while path:
                k = at[path[-1]]
                if k == end[path[-1]]:
                    path.pop()
                    if steps:
                        steps.pop()
                    continue
                at[path[-1]] = k + 1
                if to[k] in used:
                    continue
                used.add(to[k])
                steps.append(k)
                if then[k] < 0:
                    taken += steps
                    break
                path.append(then[k])
        e = e[taken]
        self.edge[heads[e]] = tight[e]
        self.mate[tails[e]] = heads[e]
        return True

    def chosen(self) -> np.ndarray:
        """The places of the edges taken, ascending."""
        return np.sort(self.edge[self.edge >= 0])

    def loose(self) -> np.ndarray:
        """Whether another matching of the same size and cost goes without each chosen edge.

        So it is where its ends lie on a cycle of the residual graph without cost,
        that is, in one strongly connected component of its tight edges; the
        source and the sink stand for what is left unmatched.
        """
        chosen = self.chosen()
        source, sink = self.lefts + self.rights, self.lefts + self.rights + 1
        right = lambda y: y + self.lefts
        taken = np.zeros(len(self.a), bool)
        taken[chosen] = True
        rest = np.flatnonzero((self.cost + self.at_a[self.a] == self.at_b[self.b]) & ~taken)
        free_a, free_b = np.flatnonzero(self.edge < 0), np.flatnonzero(self.mate < 0)
        back_a, back_b = np.flatnonzero((self.edge >= 0) & (self.at_a == 0)), np.flatnonzero((self.mate >= 0) & (self.at_b == self.far))
        one = lambda x, node: np.full(len(x), node)
        x = np.concatenate([self.a[rest], right(self.b[chosen]), one(free_a, source), back_a, right(free_b), one(back_b, sink)])
        y = np.concatenate([right(self.b[rest]), self.a[chosen], free_a, one(back_a, source), one(free_b, sink), right(back_b)])
        by = np.argsort(x, kind="stable")
        cuts, to = np.searchsorted(x[by], np.arange(sink + 2)).tolist(), y[by].tolist()
        part = np.array(strong([to[i:j] for i, j in zip(cuts, cuts[1:])]))
        return part[self.a[chosen]] == part[right(self.b[chosen])]


def strong(edges: list[list[int]]) -> list[int]:
    """The strongly connected component of each node."""
    order, low, part, number = [-1] * len(edges), [0] * len(edges), [-1] * len(edges), 0
    for root in range(len(edges)):
        if order[root] >= 0:
            continue
        stack, work = [], [(root, iter(edges[root]))]
        order[root] = low[root] = number
        number += 1
        stack.append(root)
        while work:
            x, rest = work[-1]
            for y in rest:
                if order[y] < 0:
                    order[y] = low[y] = number
                    number += 1
                    stack.append(y)
                    work.append((y, iter(edges[y])))
                    break
                if part[y] < 0:
                    low[x] = min(low[x], order[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == order[x]:
                    while True:
                        y = stack.pop()
                        part[y] = x
                        if y == x:
                            break
    return part
