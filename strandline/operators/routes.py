"""Open tours through many rows without a table of distances: the same paths as ``tours``' methods, in memory that grows with the rows alone.

Each step of a tour needs the one before, so a tour is one task's sequence of steps. A step asks the blocks of rows or segments that may matter
(``boxes``) and takes exact distances to few; it doesn't look at all that are left. Ties go as in ``tours``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from .boxes import SIZE, Boxes, Lists, Rows, Segments, from_point


def farthest_ends(rows: Rows) -> tuple[int, int]:
    """The farthest pair, as ``tours.ends`` gives it. Rows go from the farthest from the mean inwards, and meet only those with which they can be as far apart as the best pair so far."""
    r = np.sqrt(rows.size) * rows.radius
    order = np.argsort(-r, kind="stable")
    r, every = r[order], np.arange(len(rows))
    first = int(np.argmax(rows.between(order[0], every)))
    best = float(rows.between(first, every).max())
    if best == 0:
        return 1, 0
    found = None
    slack = 1e-6 * rows.radius
    for at in range(0, len(r), 64):
        upto = int(np.searchsorted(-r, -(best - r[at] - slack), side="right"))  # rows with r >= best - r[at]
        if upto <= at:
            break
        a, b = order[at : at + 64], order[:upto]
        d = rows.between(a[:, None], b)
        top = float(d.max())
        if top >= best:
            i, j = np.nonzero(d == top)
            low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
            k = np.lexsort((high, low))[0]
            pair = (-top, int(low[k]), int(high[k]))
            found = pair if found is None or pair < found else found
            best = top
    return found[2], found[1]


def nearest_neighbour(rows: Rows, start: int) -> np.ndarray:
    lists = Lists(rows, np.delete(np.arange(len(rows)), start))
    path = [start]
    while lists.count:
        path.append(lists.first(path[-1])[0])
        lists.take(path[-1])
    return np.array(path)


class Path:
    """Segments of a path that grows by insertions: ends a, b and length, and labels that keep the order along the path."""

    def __init__(self, rows: Rows, start: int, end: int):
        n = len(rows)
        self.rows, self.count, self.segments = rows, 1, Segments(rows)
        self.a, self.b = np.empty(n, np.int64), np.empty(n, np.int64)
        self.length = np.empty(n)
        self.label = np.zeros(n)
        self.next = np.full(n, -1)
        self.start = start
        self.label[end] = 1.0
        self.put(0, start, end, rows.pair(start, end))

    def middle(self, s: int) -> np.ndarray:
        return (self.rows.unit[self.a[s]] + self.rows.unit[self.b[s]]) / 2

    def put(self, s: int, a: int, b: int, length: float) -> None:
        self.a[s], self.b[s], self.next[a], self.length[s] = a, b, b, length
        self.segments.add(s, self.middle(s).tolist(), length / self.rows.radius)

    def cost(self, node, s) -> np.ndarray:
        return self.rows.between(self.a[s], node) + self.rows.between(self.b[s], node) - self.length[s]

    def cost_at(self, node: int, s: int) -> float:
        return self.rows.pair(int(self.a[s]), node) + self.rows.pair(int(self.b[s]), node) - float(self.length[s])

    def cheapest(self, node: int, most: float) -> tuple[float, int]:
        """The least cost of a row, of which ``most`` is one that a segment gives, and the first segment that has it."""
        s = self.segments.within(node, max(0.0, most) / self.rows.radius)
        cost = self.cost(node, s) if len(s) > 1 else np.array([self.cost_at(node, int(s[0]))])
        least = cost.min()
        s = s[cost == least]
        return float(least), int(s[0] if len(s) == 1 else s[np.argmin(self.label[self.a[s]])])

    def insert(self, node: int, s: int) -> int:
        """Puts the row into a segment; the first part keeps the segment's number, and the number of the second is given."""
        a, b, new = int(self.a[s]), int(self.b[s]), self.count
        self.count += 1
        self.label[node] = (self.label[a] + self.label[b]) / 2
        crowded = not self.label[a] < self.label[node] < self.label[b]
        self.segments.remove(s)
        self.put(s, a, node, self.rows.pair(a, node))
        self.put(new, node, b, self.rows.pair(node, b))
        if crowded:
            path = self.path()
            self.label[path] = np.arange(len(path), dtype=float)
        return new

    def path(self) -> np.ndarray:
        out, follow = [self.start], self.next.tolist()
        while follow[out[-1]] >= 0:
            out.append(follow[out[-1]])
        return np.array(out)


def nearest_first(rows: Rows, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Each time the row that is nearest to those before, and the one it is near to. Those before offer their nearest; an offer that is gone is renewed when its turn comes."""
    lists, offers = Lists(rows, np.delete(np.arange(len(rows)), [start, end])), []

    def offer(of: int) -> None:
        other, d = lists.offer(of)
        heapq.heappush(offers, (d, other, of))

    offer(start)
    offer(end)
    while lists.count:
        _, node, by = heapq.heappop(offers)
        if node < 0:
            if lists.offer(by)[0] < 0:  # lists of others that wait may have brought its own
                lists.search(by, lists.waiting(by) if lists.made[by] else None)
        elif lists.left[node]:
            lists.take(node)
            yield node, by
            offer(node)
        offer(by)


def farthest_first(rows: Rows, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Each time the row that is farthest from those before, and the one it is nearest to."""
    index = np.delete(np.arange(len(rows)), [start, end])
    if not len(index):
        return
    boxes = Boxes(rows, index)
    ids, features = boxes.ids, boxes.flat
    from_start, from_end = rows.between(ids, start), rows.between(ids, end)
    near, by = np.where(ids < 0, -np.inf, np.minimum(from_start, from_end)), np.where(from_start <= from_end, start, end)
    grid = near.reshape(-1, SIZE)
    most, size = grid.max(axis=1), features[:, -1].copy()
    reach = (np.maximum(most, 0) / rows.radius) ** 2 + rows.slack
    features[:, -1] -= (np.maximum(near, 0) / rows.radius) ** 2
    for _ in range(len(index)):
        top = most.max()
        blocks = (most == top).nonzero()[0]
        i, j = (grid[blocks] == top).nonzero()
        at = blocks[i] * SIZE + j
        at = int(at[0] if len(at) == 1 else at[np.argmin(ids[at])])
        node = int(ids[at])
        yield node, int(by[at])
        near[at], features[at, -1] = -np.inf, np.inf
        blocks = (boxes.apart(node) <= reach).nonzero()[0]
        ask = np.array([*(-2 * rows.unit[node]).tolist(), 1.0], rows.kind)
        k = (boxes.taken(blocks) @ ask <= rows.slack - rows.size[node]).nonzero()[0]
        k = boxes.slots(blocks, k)
        d = rows.between(ids[k], node)
        less = d < near[k]
        k, d = k[less], d[less]
        near[k], by[k] = d, node
        features[k, -1] = size[k] - (d / rows.radius) ** 2
        blocks = np.array(list({at // SIZE, *(k // SIZE).tolist()}))
        most[blocks] = grid[blocks].max(axis=1)
        reach[blocks] = (np.maximum(most[blocks], 0) / rows.radius) ** 2 + np.where(most[blocks] < 0, -np.inf, rows.slack)


def insertion(rows: Rows, start: int, end: int, farthest: bool) -> np.ndarray:
    """The next row is the farthest from the path, or the nearest to it."""
    path = Path(rows, start, end)
    # Segments next to a row's nearest one give it a cost that it need not exceed: one that leaves each row.
    out = np.zeros(len(rows), np.int64)
    for node, by in (farthest_first if farthest else nearest_first)(rows, start, end):
        s = int(out[by])
        least, s = path.cheapest(node, path.cost_at(node, s))
        new = path.insert(node, s)
        out[path.a[s]], out[node] = s, new
        if path.b[new] == end:
            out[end] = new
    return path.path()


def cheapest_insertion(rows: Rows, start: int, end: int) -> np.ndarray:
    """The next row is the one that costs least. Of each row ``most`` is the cost of a segment that stands, and ``least`` is no more than its true cost; equal ones are exact."""
    n, path = len(rows), Path(rows, start, end)
    index = np.delete(np.arange(n), [start, end])
    if not len(index):
        return path.path()
    boxes = Boxes(rows, index)
    ids = boxes.ids
    none = ids < 0
    least = np.where(none, np.inf, path.cost(ids, np.zeros(len(ids), np.int64)))
    most, by = np.where(none, -np.inf, least), np.where(none, -1, 0)
    # A slot's features: place, square - most^2 / 4 and most, which is 0 or more here.
    wide = np.zeros((len(ids), boxes.flat.shape[1] + 1), rows.kind)
    wide[:, :-1] = boxes.flat
    size = boxes.flat[:, -1].copy()
    boxes.features, boxes.flat = wide.reshape(-1, SIZE, wide.shape[1]), wide
    low, high = least.reshape(-1, SIZE), most.reshape(-1, SIZE)
    lowest, reach = low.min(axis=1), np.zeros(len(low))

    def bound(k) -> None:
        v = np.maximum(0.0, most[k]) / rows.radius
        wide[k, -2], wide[k, -1] = size[k] - v * v / 4, v

    bound(np.flatnonzero(~none))
    reach = high.max(axis=1)
    held = {0: np.flatnonzero(~none).tolist()}  # slots by the segment whose cost ``most`` is, and some that were
    for _ in range(n - 2):
        while True:
            top = lowest.min()
            blocks = np.flatnonzero(lowest == top)
            at = (blocks[:, None] * SIZE + np.arange(SIZE)).ravel()
            at = at[least[at] == top]
            at = int(at[np.argmin(ids[at])])
            if least[at] == most[at]:
                break
            least[at], by[at] = path.cheapest(int(ids[at]), float(most[at]))
            most[at] = least[at]
            held.setdefault(int(by[at]), []).append(at)
            bound(at)
            lowest[at // SIZE] = low[at // SIZE].min()
        node = int(ids[at])
        split = path.cheapest(node, float(most[at]))[1]
        new = path.insert(node, split)
        least[at], most[at], by[at] = np.inf, -np.inf, -1
        wide[at, -2:] = np.inf, 0
        lost = np.array(held.pop(split, []), np.int64)
        lost = np.unique(lost[by[lost] == split])
        most[lost] = np.inf
        touched = [lost, [at]]
        for s in (split, new):
            m, length = path.middle(s), path.length[s] / rows.radius
            q = m.astype(rows.kind)
            u = (np.maximum(reach, 0) / rows.radius + length) / 2
            blocks = np.flatnonzero((from_point(boxes.low, boxes.high, q) <= u * u + rows.slack) & (reach > -np.inf))
            ask = np.concatenate([-2 * m, [1.0, -length / 2]]).astype(rows.kind)
            k = np.flatnonzero(boxes.taken(blocks) @ ask <= length * length / 4 - m @ m + rows.slack)
            k = np.append(boxes.slots(blocks, k), lost)
            cost = path.cost(ids[k], s)
            less = cost < most[k]
            k, cost = k[less], cost[less]
            most[k], by[k] = cost, s
            least[k] = np.minimum(least[k], cost)
            held.setdefault(s, []).extend(k.tolist())
            bound(k)
            touched.append(k)
        blocks = np.unique(np.concatenate(touched) // SIZE).astype(np.int64)
        lowest[blocks], reach[blocks] = low[blocks].min(axis=1), high[blocks].max(axis=1)
    return path.path()


class Edges:
    """Edges of a path, by the place of their second row: ``length``, and ``hot`` where reconnecting the edge with another might gain, whichever way round the two stand.

    A reversal changes two edges, and which way round the others stand. So a sweep asks hot edges alone: the rest gain nothing, however the path runs.
    """

    def __init__(self, rows: Rows, p: np.ndarray):
        n = len(p)
        self.rows, self.p, self.boxes = rows, p, Boxes(rows, np.arange(n))
        self.place = np.empty(n, np.int64)
        self.place[p] = np.arange(n)
        self.length = np.zeros(n + 1)
        self.length[1:n] = rows.between(p[:-1], p[1:])
        self.hot = np.ones(n, bool)
        self.least = 1e-12 - 4e-15 * rows.radius  # gains are taken in another order here
        # The squared longest edge at each row.
        self.reach = np.zeros(self.boxes.ids.shape, rows.kind)
        self.grid = self.reach.reshape(-1, SIZE)
        self.most = np.zeros(len(self.grid), rows.kind)
        self.measure(p)

    def measure(self, rows_of: np.ndarray) -> None:
        """Edges at these rows have changed."""
        slot, at = self.boxes.slot[rows_of], self.place[rows_of]
        self.reach[slot] = (np.maximum(self.length[at], self.length[at + 1]) / self.rows.radius) ** 2
        blocks = np.array(list(set((slot // SIZE).tolist())))
        self.most[blocks] = self.grid[blocks].max(axis=1)

    def around(self, row: int, length: float) -> np.ndarray:
        """Places of rows that are nearer than the length, or than an edge of their own is long."""
        rows, boxes, square = self.rows, self.boxes, (length / self.rows.radius) ** 2
        blocks = (boxes.apart(row) <= np.maximum(self.most, square) + rows.slack).nonzero()[0]
        ask = np.array([*(-2 * rows.unit[row]).tolist(), 1.0], rows.kind)
        reach = self.reach if len(blocks) * 2 > len(self.grid) else self.grid.take(blocks, axis=0).ravel()
        k = (boxes.taken(blocks) @ ask <= np.maximum(reach, square) + (rows.slack - rows.size[row])).nonzero()[0]
        return self.place[boxes.ids[boxes.slots(blocks, k)]]

    def gains(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the edge before place i: places j in order, what reconnecting it with the edge after j gains (the last place has none after it), and what that would gain the other way round."""
        p, n, length = self.p, len(self.p), self.length
        before, here = int(p[i - 1]), int(p[i])
        at = np.concatenate([self.around(before, length[i]), self.around(here, length[i])])
        j = np.unique(np.concatenate([at, at - 1, [n - 1]]))
        j = j[(j >= 0) & (j != i - 1)]
        after = np.minimum(j + 1, n - 1)
        c, d, m = p[j], p[after], len(j)
        both = np.repeat([before, here, before, here], m)
        ac, bd, ad, bc = self.rows.between(both, np.concatenate([c, d, d, c])).reshape(4, m)
        inner = j < n - 1
        gain = length[i] - ac
        gain += np.where(inner, length[after] - bd, 0)
        turned = np.where(inner, length[i] - ad + (length[after] - bc), length[i] - bc)
        turned[(j == i) & inner | (j == i - 2)] = -np.inf  # edges that share a row stand as they do
        return j, gain, turned

    def warm(self, i: int, j: np.ndarray, gain: np.ndarray, turned: np.ndarray) -> None:
        """The edge, and those with which it would gain, are hot."""
        some = (gain > self.least) | (turned > self.least)
        self.hot[i] = some.any()
        j = j[some]
        self.hot[j[j < len(self.p) - 1] + 1] = True

    def turn(self, i: int, j: int) -> None:
        """Reverses the stretch from place i to place j."""
        p, n, length = self.p, len(self.p), self.length
        p[i : j + 1] = p[i : j + 1][::-1].copy()
        length[i + 1 : j + 1] = length[i + 1 : j + 1][::-1].copy()
        self.hot[i + 1 : j + 1] = self.hot[i + 1 : j + 1][::-1].copy()
        self.place[p[i : j + 1]] = np.arange(i, j + 1)
        new = [i, j + 1] if j < n - 1 else [i]
        for at in new:
            length[at] = self.rows.pair(int(p[at - 1]), int(p[at]))
        self.measure(np.unique(p[[q for at in new for q in (at - 1, at)] + [j]]))
        for at in new:
            self.warm(at, *self.gains(at))
        if j == n - 1:  # the path ends elsewhere
            to_end = self.rows.between(p, p[-1])
            self.hot[1:] |= length[1:n] - np.minimum(to_end[:-1], to_end[1:]) > self.least


def two_opt(rows: Rows, start: int) -> np.ndarray:
    edges = Edges(rows, nearest_neighbour(rows, start))
    n, better = len(rows), True
    while better:
        better, i = False, 0
        while True:
            rest = edges.hot[i + 1 : n - 1]
            skip = int(rest.argmax()) if len(rest) else 0
            if not len(rest) or not rest[skip]:
                break
            i += skip + 1
            j, gain, turned = edges.gains(i)
            ahead = gain[j > i]
            k = int(ahead.argmax()) if len(ahead) else 0
            if len(ahead) and ahead[k] > 1e-12:
                edges.turn(i, int(j[j > i][k]))
                better = True
            else:
                edges.warm(i, j, gain, turned)
    return edges.p


def route(x: np.ndarray, method: str) -> list[int]:
    """Row numbers along the tour; rows must stand in the order that breaks ties."""
    if len(x) < 3:
        return list(range(len(x)))[::-1]
    rows = Rows(x)
    start, end = farthest_ends(rows)
    if method == "nn":
        path = nearest_neighbour(rows, start)
    elif method == "two_opt":
        path = two_opt(rows, start)
    elif method == "cheapest_insertion":
        path = cheapest_insertion(rows, start, end)
    else:
        path = insertion(rows, start, end, method == "farthest_insertion")
    return path.tolist()
