"""Distances on a mapped graph by nested dissection, for many searches of one graph.

The nodes are halved along the wider side again and again; the nodes of one half that touch the other separate the two and
belong to the cell that was cut, what is left is cut further, down to leaves.  A cell's table has the distances between its own
nodes and its border (nodes of cells above that touch it or what is below it), by ways inside alone.  The way between two nodes
climbs to a common cell, so the distances to one node are found cell by cell from the top, and only those asked for.

Walked edges cost a penalty, so each penalty has a table.  Distances are concave in the penalty: between two tables
their chord is a lower bound, which no edge undercuts.
"""

from __future__ import annotations

import heapq
import math
import os
import uuid
from bisect import bisect_left
from functools import lru_cache

import numpy as np

from ..functions.scratch import local_path, shared_dir

#: Nodes of a leaf at most, nodes of a graph that is worth it, and penalties that get a table.
LEAF, LEAST, TABLES = 128, 10_000, 8

#: Nodes of a cell and its border at most, and numbers of a table per node of the graph: beyond these the graph has no small separators.
WIDEST, NUMBERS = 4_000, 1_000

ARRAYS = ("nodes", "rank", "owner", "first", "parent", "leaf", "border", "border_at", "place", "table_at")


def _steps(index, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the edges of nodes, and which of the nodes each belongs to."""
    begin = np.asarray(index.start[some])
    count = np.asarray(index.start[some + 1]) - begin
    which = np.repeat(np.arange(len(some)), count)
    return np.arange(len(which)) + np.repeat(begin - (np.cumsum(count) - count), count), which


def dissect(index, leaf: int = LEAF) -> dict[str, np.ndarray] | None:
    """The cells of a graph, those above before those below; None if it has no small separators."""
    n = len(index.ids)
    lat = np.array(index.lat)
    lon = np.array(index.lon) * (math.cos(math.radians(float(lat.mean()))) if n else 1.0)
    side, own, parent, leaves = np.zeros(n, "i1"), [], [], []
    todo = [(np.arange(n), -1)]
    while todo:
        cell, up = todo.pop()
        parent.append(up)
        leaves.append(len(cell) <= leaf)
        if leaves[-1]:
            own.append(cell)
            continue
        along = lat if np.ptp(lat[cell]) >= np.ptp(lon[cell]) else lon
        by = np.argpartition(along[cell], len(cell) // 2)
        a, b = cell[by[: len(cell) // 2]], cell[by[len(cell) // 2 :]]
        side[b] = 1
        at, which = _steps(index, a)
        ends = index.dst[at]
        over = side[ends] == 1
        side[b] = 0
        one, two = np.unique(a[which[over]]), np.unique(ends[over])
        cut = one if len(one) <= len(two) else two
        if len(cut) > WIDEST:
            return None
        own.append(cut)
        side[cut] = 1
        todo += [(rest, len(own) - 1) for x in (a, b) if len(rest := x[side[x] == 0])]
        side[cut] = 0
    nodes = np.concatenate(own)
    rank = np.empty(n, "i8")
    rank[nodes] = np.arange(n)
    first = np.concatenate(([0], np.cumsum([len(x) for x in own])))
    border, place = [None] * len(own), [None] * len(own)
    above: list[list[np.ndarray]] = [[] for _ in own]
    for k in range(len(own) - 1, -1, -1):
        at, _ = _steps(index, own[k])
        found = np.unique(np.concatenate([rank[index.dst[at]], *above[k]]))
        border[k], above[k] = found[found < first[k]], []
        if parent[k] >= 0:
            above[parent[k]].append(border[k])
        if len(own[k]) + len(border[k]) > WIDEST:
            return None
    for k, up in enumerate(parent):
        b = border[k]
        width = first[up + 1] - first[up]
        place[k] = np.where(b >= first[up], b - first[up], width + np.searchsorted(border[up], b)) if up >= 0 else b
    width, edge = np.diff(first), np.array([len(x) for x in border])
    numbers = width * (edge + np.where(leaves, 0, width))
    if numbers.sum() > NUMBERS * n:
        return None
    owner = np.empty(n, "i4")
    owner[nodes] = np.repeat(np.arange(len(own)), width)
    whole = lambda x: np.concatenate(([0], np.cumsum(x)))
    return {"nodes": nodes, "rank": rank, "owner": owner, "first": first, "parent": np.array(parent), "leaf": np.array(leaves), "border": np.concatenate(border), "border_at": whole(edge), "place": np.concatenate(place), "table_at": whole(numbers)}


def table(index, cells: dict[str, np.ndarray], penalty: float) -> np.ndarray:
    """The tables of all cells at a penalty, cell by cell from below.

    Of a leaf the distances of its nodes to its border, of others also those between its nodes."""
    c = cells
    out = np.empty(int(c["table_at"][-1]))
    first, border_at, rank = c["first"], c["border_at"], c["rank"]
    below: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(len(c["parent"]) - 1, -1, -1):
        a, v = int(first[k]), int(first[k + 1] - first[k])
        b = c["border"][border_at[k] : border_at[k + 1]]
        size = v + len(b)
        m = np.full((size, size), np.inf)
        np.fill_diagonal(m, 0.0)
        at, which = _steps(index, c["nodes"][a : a + v])
        end = rank[index.dst[at]]
        up, same = end < a, (end >= a) & (end < a + v)
        some = up | same
        to = np.where(up, v + np.searchsorted(b, end), end - a)[some]
        cost = np.where(index.walked[at], index.weight[at] * penalty, index.weight[at])[some]
        np.minimum.at(m, (which[some], to), cost)
        np.minimum.at(m, (to, which[some]), cost)
        for place, inner in below.pop(k, ()):
            where = np.ix_(place, place)
            m[where] = np.minimum(m[where], inner)
        buffer = np.empty_like(m)
        for i in range(v):
            np.add(m[:, i, None], m[i], out=buffer)
            np.minimum(m, buffer, out=m)
        if c["parent"][k] >= 0:
            below.setdefault(int(c["parent"][k]), []).append((c["place"][border_at[k] : border_at[k + 1]], m[v:, v:].copy()))
        kept = m[:v, v:] if c["leaf"][k] else m[:v]
        out[c["table_at"][k] : c["table_at"][k + 1]] = kept.ravel()
    return out


class Field:
    """Distances of nodes to one node at a penalty that has a table."""

    def __init__(self, index, cells: dict[str, np.ndarray], numbers: np.ndarray, penalty: float, root: int):
        self.index, self.cells, self.numbers, self.penalty, self.root = index, cells, numbers, penalty, root
        self.known: dict[int, float] = {}
        self.far = np.empty(len(cells["nodes"]))
        self.done: set[int] = set()
        self._climb()

    def _cell(self, k: int):
        """Where a cell's nodes begin and how many it has, its border and its table."""
        a, v, b, begin, end, width, _ = self._seen(k)
        return a, v, b, self.numbers[begin:end].reshape(v, width)

    def _seen(self, k: int) -> tuple:
        """What all fields of a process ask of a cell: where its nodes begin, their number, its border, its table's place and width, its nodes."""
        seen = self.cells.setdefault("seen", {})
        found = seen.get(k)
        if found is None:
            c = self.cells
            a, v = int(c["first"][k]), int(c["first"][k + 1] - c["first"][k])
            b = np.array(c["border"][c["border_at"][k] : c["border_at"][k + 1]])
            found = seen[k] = a, v, b, int(c["table_at"][k]), int(c["table_at"][k + 1]), len(b) + (0 if c["leaf"][k] else v), c["nodes"][a : a + v].tolist()
        return found

    def _climb(self) -> None:
        """Distances of the cells above the node, and of its own."""
        c = self.cells
        k = int(c["owner"][self.root])
        a, v, b, m = self._cell(k)
        found = self._inside(k, a, v, b) if c["leaf"][k] else m[int(c["rank"][self.root]) - a]
        chain = [(k, found[:v])]
        while c["parent"][k] >= 0:
            place, k = c["place"][c["border_at"][k] : c["border_at"][k + 1]], int(c["parent"][k])
            a, width, b, m = self._cell(k)
            up = np.full(width + len(b), np.inf)
            up[place] = found[v:]
            v = width
            found = np.minimum(up, (up[:v, None] + m).min(0)) if v else up
            chain.append((k, found[:v]))
        for k, own in reversed(chain):
            self._take(k, own)

    def _inside(self, k: int, a: int, v: int, b: np.ndarray) -> np.ndarray:
        """Distances in a leaf from the node to the leaf's nodes and its border."""
        rank, near, penalty = self.cells["rank"], self.index.near, self.penalty
        out = np.full(v + len(b), np.inf)
        cost, heap = {self.root: 0.0}, [(0.0, self.root)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > cost[u]:
                continue
            r = int(rank[u])
            if r < a:
                out[v + int(np.searchsorted(b, r))] = d
                continue
            out[r - a] = d
            for x, w, old in near(u):
                n = d + (w * penalty if old else w)
                if n < cost.get(x, math.inf):
                    cost[x] = n
                    heapq.heappush(heap, (n, x))
        return out

    def _take(self, k: int, own: np.ndarray | None = None) -> None:
        a, v, b, begin, end, width, nodes = self._seen(k)
        if v and len(b):
            found = (self.numbers[begin:end].reshape(v, width)[:, width - len(b) :] + self.far[b]).min(1)
            if own is not None:
                found = np.minimum(found, own)
        else:
            found = np.full(v, math.inf) if own is None else own
        self.far[a : a + v] = found
        self.known.update(zip(nodes, found.tolist()))
        self.done.add(k)

    def at(self, node: int) -> float:
        """The distance of a node; infinite if there is no way."""
        found = self.known.get(node)
        if found is None:
            parent, todo, k = self.cells["parent"], [], int(self.cells["owner"][node])
            while k not in self.done:
                todo.append(k)
                k = int(parent[k])
            for k in reversed(todo):
                self._take(k)
            found = self.known[node]
        return found


class Fields:
    """Fields of one node at all penalties that have tables, each made when it is needed."""

    def __init__(self, index, cells, tables: dict[float, np.ndarray], root: int):
        self.index, self.cells, self.tables, self.root, self.own = index, cells, tables, root, {}

    def field(self, penalty: float) -> Field:
        if penalty not in self.own:
            self.own[penalty] = Field(self.index, self.cells, self.tables[penalty], penalty, self.root)
        return self.own[penalty]

    def bound(self, penalty: float):
        """A lower bound of a node's distance at a penalty, exact at those that have tables; a trifle less against rounding."""
        have = sorted(self.tables)
        i = bisect_left(have, penalty)
        if i < len(have) and have[i] == penalty:
            at, known = self.field(penalty).at, self.field(penalty).known.get

            def distance(node: int) -> float:
                found = known(node)
                return at(node) if found is None else found

            def bound(node: int) -> float:
                return distance(node) * (1 - 1e-9)

            bound.exact = distance
            return bound
        if i == 0 or i == len(have):
            return None
        low, high, share = self.field(have[i - 1]).at, self.field(have[i]).at, (penalty - have[i - 1]) / (have[i] - have[i - 1])

        def chord(node: int) -> float:
            one = low(node)
            return one if one == math.inf else (one * (1 - share) + high(node) * share) * (1 - 1e-9)

        return chord


@lru_cache(2)
def _cells(path: str) -> dict[str, np.ndarray]:
    # plain views: slices of what numpy maps are slow to make
    return {c: np.load(f"{path}/{c}.npy", mmap_mode="r").view(np.ndarray) for c in ARRAYS}


@lru_cache(32)
def _table(path: str, penalty: float) -> np.ndarray:
    return np.load(f"{path}/table-{penalty!r}.npy", mmap_mode="r").view(np.ndarray)


def _save(path: str, values: np.ndarray) -> None:
    """Whole or not at all, as a task may be run twice."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, values)
    os.replace(own, path)


class Prepared:
    """The cells and tables of a mapped graph, made by tasks in the folder that all share; a task maps them."""

    def __init__(self, spark, mapped, penalties, leaf: int = LEAF):
        self.path, self.penalties, self.mapped = local_path(f"{shared_dir(spark)}/hierarchy-{uuid.uuid4().hex}"), tuple(sorted(set(map(float, penalties)))), mapped
        path = self.path
        os.makedirs(path, exist_ok=True)

        def cut(_) -> bool:
            cells = dissect(mapped.value, leaf)
            for c in ARRAYS if cells is not None else ():
                _save(f"{path}/{c}.npy", cells[c])
            return cells is not None

        def fill(penalty: float) -> float:
            _save(f"{path}/table-{penalty!r}.npy", table(mapped.value, {c: np.array(_cells(path)[c]) for c in ARRAYS}, penalty))
            return penalty

        context = spark.sparkContext
        self.made = context.parallelize([0], 1).map(cut).collect()[0]  # one truth value
        if self.made and self.penalties:
            context.parallelize(self.penalties, len(self.penalties)).map(fill).collect()  # a number a table

    @property
    def cells(self) -> dict[str, np.ndarray]:
        return _cells(self.path)

    def fields(self, root: int) -> Fields:
        return Fields(self.mapped.value, _cells(self.path), {p: _table(self.path, p) for p in self.penalties}, root)


def prepared(spark, mapped, penalties) -> Prepared | None:
    """``Prepared`` where it helps: a large graph with small separators, and a shared folder that is mounted."""
    if mapped.n < LEAST or mapped.path is None or not penalties or min(penalties) < 0:
        return None
    found = Prepared(spark, mapped, penalties)
    return found if found.made else None
