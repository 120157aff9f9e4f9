"""Kernels on one simplicial complex: orders, reductions, gradients and trees, without Spark.

A simplex is the tuple of the ranks of its vertices, greatest first, so that tuples sort as the lower-star filtration.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np

Simplex = tuple[int, ...]


def closure(cells: Iterable[Simplex]) -> list[Simplex]:
    """All faces of the cells (tuples in descending rank), in filtration order."""
    found = set()
    for c in cells:
        for n in range(1, len(c) + 1):
            found.update(combinations(c, n))
    return sorted(found)


def facets(s: Simplex) -> list[Simplex]:
    return [s[:i] + s[i + 1 :] for i in range(len(s))] if len(s) > 1 else []


def reduction(simplices: list[Simplex]) -> tuple[list[tuple[Simplex, Simplex]], list[Simplex], dict[Simplex, set[int]]]:
    """Pairs (birth, death), essential simplices, and the boundary cycle (places in the list) that each death fills.

    Columns are reduced modulo 2, cells of high dimension first, so that the births that they kill need no column.
    """
    place = {s: i for i, s in enumerate(simplices)}
    by_size = defaultdict(list)
    for s in simplices:
        by_size[len(s)].append(s)
    pairs, cycles, killed, deaths = [], {}, set(), set()
    for size in sorted(by_size, reverse=True):
        owner: dict[int, set[int]] = {}
        for s in by_size[size]:
            if s in killed or size == 1:
                continue
            column = {place[f] for f in facets(s)}
            while column and (low := max(column)) in owner:
                column ^= owner[low]
            if column:
                low = max(column)
                owner[low] = column
                pairs.append((simplices[low], s))
                cycles[s] = column
                killed.add(simplices[low])
                deaths.add(s)
    return pairs, [s for s in simplices if s not in killed and s not in deaths], cycles


def lower_star_gradient(x: int, star: list[Simplex]) -> list[tuple[Simplex, Simplex | None]]:
    """(cell, the cell of one dimension more that it points to, or None where it is critical) of a vertex and its lower star.

    Cells are paired while one has a single unpaired face, the least first; what is left alone is critical.
    """
    if not star:
        return [((x,), None)]
    cofaces, left = defaultdict(list), set(star)
    for s in star:
        for f in facets(s):
            if f in left:
                cofaces[f].append(s)
    open_faces = lambda s: [f for f in facets(s) if f in left]
    out = []
    first = min(s for s in star if len(s) == 2)
    out.append(((x,), first))
    left.discard(first)
    zero = [s for s in star if len(s) == 2 and s != first]
    one = [s for s in cofaces[first] if len(open_faces(s)) == 1]
    heapify(zero)
    heapify(one)
    while zero or one:
        while one:
            s = heappop(one)
            if s not in left:
                continue
            faces = open_faces(s)
            if not faces:
                heappush(zero, s)
                continue
            out.append((faces[0], s))
            left -= {faces[0], s}
            for t in cofaces[s] + cofaces[faces[0]]:
                if t in left and len(open_faces(t)) == 1:
                    heappush(one, t)
        while zero:
            s = heappop(zero)
            if s in left:
                out.append((s, None))
                left.discard(s)
                for t in cofaces[s]:
                    if t in left and len(open_faces(t)) == 1:
                        heappush(one, t)
                break
    return out


class Forest:
    """Union-find over places; the root of a set is its least rank."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def augmented_tree(order: list[int], near: list[list[int]]) -> list[int]:
    """For each vertex the next one, in sweep order, where its component grows; -1 at the end. Vertices are swept in `order`."""
    n = len(order)
    rank = [0] * n
    for k, x in enumerate(order):
        rank[x] = k
    sets, last, after = Forest(n), list(range(n)), [-1] * n
    for x in order:
        for y in near[x]:
            if rank[y] < rank[x] and (r := sets.root(y)) != sets.root(x):
                after[last[r]] = x
                sets.up[r] = sets.root(x)
                last[sets.root(x)] = x
        last[sets.root(x)] = x
    return after


def contour_tree(values: np.ndarray, ids: np.ndarray, near: list[list[int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Arcs (lower node, upper node) between places, and the arc of each vertex, of a connected, simply connected domain.

    Leaves of the join and of the split tree are taken off in turn; regular vertices go to the arc that they stand on.
    """
    n = len(values)
    rising = np.lexsort((ids, values)).tolist()
    join, split = augmented_tree(rising, near), augmented_tree(rising[::-1], near)
    join_kids, split_kids = [set() for _ in range(n)], [set() for _ in range(n)]
    for x in range(n):
        if join[x] >= 0:
            join_kids[join[x]].add(x)
        if split[x] >= 0:
            split_kids[split[x]].add(x)
    leaf = lambda x: len(join_kids[x]) + len(split_kids[x]) == 1 or (not join_kids[x] and not split_kids[x])
    links, queue, gone = [], [x for x in range(n) if leaf(x)], [False] * n

    def cut(x: int, up: list[int], kids: list[set[int]]) -> None:
        for k in kids[x]:
            up[k] = up[x]
            if up[x] >= 0:
                kids[up[x]].add(k)
        if up[x] >= 0:
            kids[up[x]].discard(x)
        kids[x].clear()

    while queue:
        x = queue.pop()
        if gone[x] or not leaf(x):
            continue
        to = join[x] if not join_kids[x] and join[x] >= 0 else split[x]
        if to < 0:
            gone[x] = True
            continue
        links.append((x, to))
        gone[x] = True
        cut(x, join, join_kids)
        cut(x, split, split_kids)
        if leaf(to):
            queue.append(to)
    rank = np.empty(n, np.int64)
    rank[rising] = np.arange(n)
    ups, downs = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in links:
        low, high = (a, b) if rank[a] < rank[b] else (b, a)
        ups[low].append(high)
        downs[high].append(low)
    nodes = [x for x in rising if len(ups[x]) != 1 or len(downs[x]) != 1]
    is_node, arcs, arc_of = set(nodes), [], np.full(n, -1)
    for x in nodes:
        for y in ups[x]:
            number = len(arcs)
            while y not in is_node:
                arc_of[y] = number
                y = ups[y][0]
            arcs.append((x, y))
    for x in nodes:  # a node counts to the arc below it, or to that above
        own = [k for k, (a, b) in enumerate(arcs) if b == x] or [k for k, (a, b) in enumerate(arcs) if a == x] if len(arcs) < 64 else None
        arc_of[x] = own[0] if own else -1
    if (arc_of < 0).any():
        below = {b: k for k, (a, b) in reversed(list(enumerate(arcs)))}
        above = {a: k for k, (a, b) in reversed(list(enumerate(arcs)))}
        for x in np.flatnonzero(arc_of < 0).tolist():
            arc_of[x] = below.get(x, above.get(x, -1))
    return arcs, arc_of


def flattened(values: np.ndarray, ids: np.ndarray, near: list[list[int]], rising: bool, dropped) -> np.ndarray:
    """Values with some minima (rising) filled up, or maxima cut down, to the saddle at which their component ends.

    `dropped(x, met)` says which of the extrema `met` of the components that vertex x joins end there, the eldest first,
    and which one goes on. Each vertex takes the furthest level of all the components that it was in.
    """
    n = len(values)
    order = np.lexsort((ids, values))
    order = (order if rising else order[::-1]).tolist()
    rank = [0] * n
    for k, x in enumerate(order):
        rank[x] = k
    sets, node_of, up, level = Forest(n), [0] * n, [], []
    node, extremum = {}, {}  # by root

    def new() -> int:
        up.append(-1)
        level.append(None)
        return len(up) - 1

    for x in order:
        roots = sorted({sets.root(y) for y in near[x] if rank[y] < rank[x]}, key=lambda r: rank[extremum[r]])
        if not roots:
            node[x], extremum[x] = new(), x
        else:
            ends, on = dropped(x, [extremum[r] for r in roots])
            if len(roots) > 1:
                made = new()
                for r in roots:
                    up[node[r]] = made
                    if extremum[r] in ends:
                        level[node[r]] = values[x]
            else:
                made = node[roots[0]]
            for r in roots:
                sets.up[r] = x
            node[x], extremum[x] = made, on
        node_of[x] = node[sets.root(x)]
    best = max if rising else min
    for k in range(len(up) - 1, -1, -1):
        if up[k] >= 0 and level[up[k]] is not None:
            level[k] = level[up[k]] if level[k] is None else best(level[k], level[up[k]])
    out = values.copy()
    for x in range(n):
        if level[node_of[x]] is not None:
            out[x] = best(out[x], level[node_of[x]])
    return out
