"""Figures of the least-cost paths of many pairs at once, without the paths: nodes are eliminated cell by cell.

The cells are those of ``hierarchy``.  When a node is eliminated, each way over it between two of its cell's remaining nodes, or from
an end of a pair to one, becomes a number: its cost, length, edges and new edges.  Ways with another last-eliminated node are other ways, so
the least gap to another way is kept as well, and a pair whose gap is rounding only is left to a search, whose ties decide.
"""

from __future__ import annotations

import numpy as np

from .hierarchy import _steps

#: Nodes of a leaf, and rows of ends that are updated together.
LEAF, ROWS = 24, 1024

#: Cost where there is no way; a real cost added to it leaves it as it is.
FAR = 1e30

#: New edges are counted in the lower half of a number, edges in the upper.
HALF = 32


class _Ways:
    """Ways from each row's node to each column's: cost, length, edges, and the gap to the next best way."""

    def __init__(self, *parts: np.ndarray):
        self.parts = parts

    @classmethod
    def none(cls, rows: int, columns: int) -> _Ways:
        shape = rows, columns
        return cls(np.full(shape, FAR), np.zeros(shape), np.zeros(shape, "i8"), np.full(shape, np.inf))

    def __getitem__(self, at) -> _Ways:
        return _Ways(*(x[at] for x in self.parts))

    def __setitem__(self, at, other: _Ways) -> None:
        for x, y in zip(self.parts, other.parts):
            x[at] = y

    def improve(self, one: _Ways, two: _Ways) -> None:
        """The better of each way and that from ``one``'s row on by ``two``'s column."""
        cost, length, edges, gap = self.parts
        (a, b, c, e), (f, g, h, i) = one.parts, two.parts
        a, e = a[:, None], e[:, None]
        worse = a + f
        worse -= cost
        better = worse < 0
        np.copyto(gap, np.minimum(e, i), where=better)
        np.abs(worse, out=worse)
        np.minimum(gap, worse, out=gap)
        np.add(a, f, out=cost, where=better)
        np.add(b[:, None], g, out=length, where=better)
        np.add(c[:, None], h, out=edges, where=better)

    def merged(self, other: _Ways) -> _Ways:
        """The better of two sets of different ways, place by place."""
        worse = other.parts[0] - self.parts[0]
        better = worse < 0
        out = [np.where(better, y, x) for x, y in zip(self.parts, other.parts)]
        out[3] = np.minimum(out[3], np.abs(worse))
        return _Ways(*out)


def figures(index, cells: dict[str, np.ndarray], penalty: float, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the least-cost path of each pair of different nodes: cost (``FAR`` if there is none), length, edges, new edges, and how much the next best path costs more."""
    first, border_at, parent, rank = cells["first"], cells["border_at"], cells["parent"], cells["rank"]
    ends, of = np.unique(np.concatenate((rank[source], rank[target])), return_inverse=True)
    one, two = of[: len(source)], of[len(source) :]
    best = _Ways(np.full(len(one), FAR), np.zeros(len(one)), np.zeros(len(one), "i8"), np.full(len(one), np.inf))
    # each pair is looked at in the last cell that has both ends below it, and in all above
    below: dict[int, list] = {}
    slot_of = np.full(len(ends), -1)
    by_end = np.argsort(one, kind="stable")
    pairs_at = np.searchsorted(one[by_end], np.arange(len(ends) + 1))
    for k in range(len(parent) - 1, -1, -1):
        a, v = int(first[k]), int(first[k + 1] - first[k])
        b = cells["border"][border_at[k] : border_at[k + 1]]
        size = v + len(b)
        under = below.pop(k, [])
        here = np.arange(*np.searchsorted(ends, (a, a + v)))
        some = np.concatenate([here, *(x[2] for x in under)])
        r = len(some)
        joint = size + (r if r <= ROWS else 0)
        m = _Ways.none(joint, size)
        at, which = _steps(index, cells["nodes"][a : a + v])
        end = rank[index.dst[at]]
        above, same = end < a, (end >= a) & (end < a + v)
        kept = above | same
        to, which, at = np.where(above, v + np.searchsorted(b, end), end - a)[kept], which[kept], at[kept]
        weight, old = index.weight[at], index.walked[at]
        # of parallel edges the lightest
        for part, values in ((0, np.where(old, weight * penalty, weight)), (1, weight)):
            x = m.parts[part]
            if part:
                x[which, to] = x[to, which] = FAR
            np.minimum.at(x, (which, to), values)
            np.minimum.at(x, (to, which), values)
        m.parts[2][which, to] = m.parts[2][to, which] = (1 << HALF) + ~old
        for place, inner, _, _ in under:
            where = np.ix_(place, place)
            m[where] = m[where].merged(inner)
        up, out = _Ways.none(r, v), _Ways.none(r, len(b))
        for low in range(0, max(r, 1), ROWS):
            rows = m[size:] if r <= ROWS else _Ways.none(min(ROWS, r - low), size)
            high, begin = min(r, low + ROWS), len(here)
            for at in range(low, min(high, begin)):
                for x, start in zip(rows.parts, (0.0, 0.0, 0, np.inf)):
                    x[at - low, ends[here[at]] - a] = start
            for place, _, who, ways in under:
                head, tail = max(low, begin), min(high, begin + len(who))
                if head < tail:
                    for x, y in zip(rows.parts, ways.parts):
                        x[head - low : tail - low, place] = y[head - begin : tail - begin]
                begin += len(who)
            if not low:  # with the rows of ends if they are few
                for i in range(v):
                    m[i + 1 :, i + 1 :].improve(m[i + 1 :, i], m[i, i + 1 :])
            if r > ROWS:
                for i in range(v):
                    rows[:, i + 1 :].improve(rows[:, i], m[i, i + 1 :])
            up[low:high], out[low:high] = rows[:, :v], rows[:, v:]
        del under, rows
        ways = inner = None
        if v and r > 1:
            slot_of[some] = np.arange(r)
            pairs = np.concatenate([by_end[pairs_at[x] : pairs_at[x + 1]] for x in some]) if r < len(ends) else np.arange(len(one))
            pairs = pairs[slot_of[two[pairs]] >= 0]
            for low in range(0, len(pairs), ROWS):
                q = pairs[low : low + ROWS]
                x, y = up[slot_of[one[q]]], up[slot_of[two[q]]]
                cost = x.parts[0] + y.parts[0]
                least = np.arange(len(q)), cost.argmin(1)
                found = _Ways(cost[least], (x.parts[1] + y.parts[1])[least], (x.parts[2] + y.parts[2])[least], np.minimum(x.parts[3], y.parts[3])[least])
                cost[least] = 2 * FAR
                found.parts[3][:] = np.minimum(found.parts[3], cost.min(1) - found.parts[0])
                best[q] = best[q].merged(found)
            slot_of[some] = -1
        if parent[k] >= 0:
            place = cells["place"][border_at[k] : border_at[k + 1]]
            below.setdefault(int(parent[k]), []).append((place, _Ways(*(x.copy() for x in m[v:size, v:].parts)), some, out))
    cost, length, edges, gap = best.parts
    return cost, length, edges >> HALF, edges & ((1 << HALF) - 1), gap
