"""Rows, and segments between them, in blocks of a k-d partition, so that a step of a tour looks at the few blocks that may matter.

A block is ``SIZE`` rows with the box around them; slots that hold none have the number -1 and an infinite square, so they match nothing.
Squares of distances come from products of features whose rounding ``Rows.slack`` allows for; who matters is then decided by exact distances.
"""

from __future__ import annotations

from math import sqrt

import numpy as np

#: Rows of a block, rows of a list of neighbours, and blocks that give the first bound of a list.
SIZE, LIST, FEW = 32, 16, 24


class Rows:
    """Rows for exact distances, and ``unit``: the same centred and scaled into the unit ball, with ``size``, their squared norms."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x)
        centred = x - x.mean(axis=0)
        self.radius = float(np.sqrt((centred**2).sum(axis=1).max())) or 1.0
        self.unit = centred / self.radius
        self.size = (self.unit**2).sum(axis=1)
        # Rows of few columns lie so near each other that single precision would tell too few of them apart.
        self.kind, self.slack = (np.float64, 1e-12) if x.shape[1] < 5 else (np.float32, 2e-5)

    def __len__(self) -> int:
        return len(self.unit)

    def between(self, a, b) -> np.ndarray:
        """Distances of the rows a and b, by pairs; squares are summed in the order of the columns."""
        gap = self.x[a] - self.x[b]
        gap *= gap
        return np.sqrt(np.add.accumulate(gap, axis=-1)[..., -1])

    def pair(self, a: int, b: int) -> float:
        """The distance of two rows, as ``between`` gives it."""
        d = 0.0
        for u, v in zip(self.x[a].tolist(), self.x[b].tolist()):
            d += (u - v) * (u - v)
        return sqrt(d)


def in_blocks(unit: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Row numbers such that each ``SIZE`` of them are a block: halves are parted across the widest column."""
    out, todo = np.array(index), [(0, len(index))]
    while todo:
        a, b = todo.pop()
        if b - a > SIZE:
            half = SIZE * (-(-(b - a) // SIZE) // 2)
            x = unit[out[a:b]]
            out[a:b] = out[a:b][np.argpartition(x[:, np.ptp(x, axis=0).argmax()], half)]
            todo += [(a, a + half), (a + half, b)]
    return out


def apart(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (a column each) from one box."""
    gap = np.maximum(low - most[:, None], least[:, None] - high)
    np.maximum(gap, 0, out=gap)
    gap *= gap
    return gap.sum(axis=0)


def from_point(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (a column each) from a point."""
    at = at[:, None]
    gap = np.maximum(low, at)
    np.minimum(gap, high, out=gap)
    gap -= at
    gap *= gap
    return np.add.reduce(gap, axis=0)


class Boxes:
    """Rows in blocks: ``ids``, and ``features``, their places and squares."""

    def __init__(self, rows: Rows, index: np.ndarray):
        self.rows, order = rows, in_blocks(rows.unit, index)
        count = -(-len(order) // SIZE)
        self.ids = np.full(count * SIZE, -1)
        self.ids[: len(order)] = order
        full = np.where(self.ids < 0, order[-1], self.ids).reshape(count, SIZE)
        x = rows.unit[full]
        self.low, self.high = (np.ascontiguousarray(v.T.astype(rows.kind)) for v in (x.min(axis=1), x.max(axis=1)))
        self.features = np.concatenate([x, rows.size[full][..., None]], axis=2).astype(rows.kind)
        self.flat = self.features.reshape(count * SIZE, -1)
        self.flat[len(order) :, -1] = np.inf
        self.slot = np.full(len(rows), -1)
        self.slot[order] = np.arange(len(order))

    def apart(self, row: int) -> np.ndarray:
        return from_point(self.low, self.high, self.rows.unit[row].astype(self.rows.kind))

    def taken(self, blocks: np.ndarray) -> np.ndarray:
        """Features of the blocks' slots."""
        if len(blocks) * 2 > len(self.features):
            return self.flat
        return self.features.take(blocks, axis=0).reshape(-1, self.features.shape[2])

    def slots(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Slots of places in what ``taken`` gave."""
        return at if len(blocks) * 2 > len(self.features) else blocks[at // SIZE] * SIZE + at % SIZE


class Lists:
    """The nearest of the rows that are left, equals by number, for rows that ask one after the other.

    A list is made when it is first asked for, for the rows of a block at once, and again for a single row whose list has run out. Blocks are made anew when half of the rows are gone.
    """

    def __init__(self, rows: Rows, index: np.ndarray):
        self.rows, n = rows, len(rows)
        here = np.zeros(n, np.uint8)
        here[index] = 1
        self.here, self.left = here, memoryview(here)
        self.count = len(index)
        self.near, self.far = np.full((n, LIST), -1, np.int32), np.zeros((n, LIST))
        self.made = np.zeros(n, bool)
        self.pack()
        self.kin, self.home = self.boxes.ids.reshape(-1, SIZE), self.boxes.slot // SIZE

    def pack(self) -> None:
        self.full = self.count
        self.boxes = Boxes(self.rows, np.flatnonzero(self.here))

    def take(self, row: int) -> None:
        self.left[row] = 0
        self.count -= 1
        if self.count >= SIZE and self.count * 2 < self.full:
            self.pack()
        else:
            self.boxes.flat[self.boxes.slot[row], -1] = np.inf

    def first(self, row: int) -> tuple[int, float]:
        """The nearest row that is left, and its distance."""
        left = self.left
        while True:
            for k, other in enumerate(self.near[row].tolist()):
                if other < 0:
                    break
                if left[other]:
                    return other, float(self.far[row, k])
            self.search(row)

    def offer(self, row: int) -> tuple[int, float]:
        """The same, or -1 and a distance that the next is not nearer than, where the row's list has run out."""
        left = self.left
        for k, other in enumerate(self.near[row].tolist()):
            if other >= 0 and left[other]:
                return other, float(self.far[row, k])
        return -1, float(self.far[row, -1])

    def waiting(self, row: int) -> np.ndarray:
        """Rows of the row's first block that are gone themselves and have no list, or one that has run out."""
        if self.home[row] < 0:
            return np.array([row])
        own = self.kin[self.home[row]]
        own = own[own >= 0]
        near = self.near[own]
        return own[(self.here[own] == 0) & ~((near >= 0) & (self.here[near] > 0)).any(axis=1)]

    def search(self, row: int, asking: np.ndarray | None = None) -> None:
        """Makes the list of a row, and those of others that ask or are near it and left, unless theirs reach too far."""
        at = self.boxes.slot[row]
        if asking is None:
            asking = np.array([row])
            if at >= 0 and not self.made[row]:
                own = self.boxes.ids[at // SIZE * SIZE : (at // SIZE + 1) * SIZE]
                own = own[own >= 0]
                asking = np.append(own[(self.here[own] > 0) & ~self.made[own]], row)
        rows, boxes = self.rows, self.boxes
        gaps = self.gaps(asking)
        some = np.argpartition(gaps, FEW)[:FEW] if len(gaps) > FEW else np.arange(len(gaps))
        square = self.squares(asking, some)
        limit = np.full(len(asking), np.inf)
        if square.shape[1] > LIST:  # one more than a list holds, as a row may find itself
            limit = np.partition(square, LIST, axis=1)[:, LIST]
        if len(asking) > 1:
            few = limit <= 1.5 * np.median(limit)
            few = few if few[asking == row][0] else asking == row
            if not few.all():
                asking, limit = asking[few], limit[few]
                gaps = self.gaps(asking)
        limit = np.minimum(limit + 2 * rows.slack, np.finfo(rows.kind).max)
        self.made[asking] = True
        blocks = (gaps <= limit.max() + rows.slack).nonzero()[0]
        square = self.squares(asking, blocks)
        i, j = np.divmod((square <= limit[:, None].astype(rows.kind)).ravel().nonzero()[0], square.shape[1])
        other = boxes.ids[boxes.slots(blocks, j)]
        use = other != asking[i]
        i, other = i[use], other[use]
        d = rows.between(asking[i], other)
        order = np.lexsort((other, d, i))
        i, other, d = i[order], other[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(asking)))[i]
        few = rank < LIST
        self.near[asking] = -1
        self.near[asking[i[few]], rank[few]], self.far[asking[i[few]], rank[few]] = other[few], d[few]

    def gaps(self, asking: np.ndarray) -> np.ndarray:
        unit = self.rows.unit[asking].astype(self.rows.kind)
        if len(asking) == 1:
            return from_point(self.boxes.low, self.boxes.high, unit[0])
        return apart(self.boxes.low, self.boxes.high, unit.min(axis=0), unit.max(axis=0))

    def squares(self, asking: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        ask = np.column_stack([-2 * self.rows.unit[asking], np.ones(len(asking))]).astype(self.rows.kind)
        out = ask @ self.boxes.taken(blocks).T
        out += self.rows.size[asking][:, None].astype(self.rows.kind)
        return out


class Segments:
    """Segments by their middles, in leaves of a k-d tree that are cut when they are full.

    A row at distance r from the middle of a segment costs at least 2 r - length there, so only segments with r <= (u + length) / 2 can cost u or less.
    """

    def __init__(self, rows: Rows):
        d = rows.unit.shape[1]
        self.rows, self.leaves, cap = rows, 1, 64
        self.low, self.high = np.full((d, cap), np.inf, rows.kind), np.full((d, cap), -np.inf, rows.kind)
        self.most = np.full(cap, -np.inf)
        self.features, self.ids, self.used = np.zeros((cap, SIZE, d + 2), rows.kind), np.full((cap, SIZE), -1), [0]
        self.features[..., d] = np.inf
        self.slot = np.full(len(rows), -1)
        # Of a node that is parted: the column, where, and its first child; of one that isn't: -1, 0 and the leaf.
        self.axis, self.cut, self.kid = [-1], [0.0], [0]

    def fresh(self) -> int:
        if self.leaves == len(self.most):
            self.low, self.high = (np.concatenate([v, np.full_like(v, e)], axis=1) for v, e in ((self.low, np.inf), (self.high, -np.inf)))
            self.most = np.concatenate([self.most, np.full_like(self.most, -np.inf)])
            self.features = np.concatenate([self.features, np.zeros_like(self.features)])
            self.features[self.leaves :, :, -2] = np.inf
            self.ids = np.concatenate([self.ids, np.full_like(self.ids, -1)])
        self.used.append(0)
        self.leaves += 1
        return self.leaves - 1

    def fill(self, leaf: int, features: np.ndarray, ids: np.ndarray) -> None:
        k = len(ids)
        self.features[leaf, :k], self.ids[leaf, :k], self.used[leaf] = features, ids, k
        self.features[leaf, k:, -2], self.ids[leaf, k:] = np.inf, -1
        self.slot[ids] = leaf * SIZE + np.arange(k)
        self.low[:, leaf] = features[:, :-2].min(axis=0)
        self.high[:, leaf] = features[:, :-2].max(axis=0)
        self.most[leaf] = features[:, -1].max()

    def make_room(self, node: int) -> None:
        leaf = self.kid[node]
        at = np.flatnonzero(self.ids[leaf] >= 0)
        features, ids = self.features[leaf, at], self.ids[leaf, at]
        if 0 < len(at) <= SIZE * 3 // 4:
            return self.fill(leaf, features, ids)
        x = features[:, :-2]
        wide = np.ptp(x, axis=0)
        j = int(wide.argmax())
        if not wide[j] > 0:  # all in one place: the leaf stays as it is, and another takes what comes
            self.kid[node] = self.fresh()
            return None
        v = x[:, j]
        cut = np.partition(v, len(v) // 2)[len(v) // 2]
        cut = cut if cut < v.max() else v[v < cut].max()
        right, new = v > cut, self.fresh()
        self.fill(leaf, features[~right], ids[~right])
        self.fill(new, features[right], ids[right])
        self.axis[node], self.cut[node], self.kid[node] = j, float(cut), len(self.axis)
        self.axis += [-1, -1]
        self.cut += [0.0, 0.0]
        self.kid += [leaf, new]
        return None

    def add(self, s: int, place: list[float], length: float) -> None:
        while True:
            node = 0
            while self.axis[node] >= 0:
                node = self.kid[node] + (place[self.axis[node]] > self.cut[node])
            leaf = self.kid[node]
            k = self.used[leaf]
            if k < SIZE:
                break
            self.make_room(node)
        self.used[leaf] = k + 1
        f = self.features[leaf, k]
        f[:] = [*place, sum(v * v for v in place) - length * length / 4, length]
        self.ids[leaf, k], self.slot[s] = s, leaf * SIZE + k
        low, high = self.low[:, leaf], self.high[:, leaf]
        np.minimum(low, f[:-2], out=low)
        np.maximum(high, f[:-2], out=high)
        if length > self.most[leaf]:
            self.most[leaf] = length

    def remove(self, s: int) -> None:
        leaf, k = divmod(int(self.slot[s]), SIZE)
        self.features[leaf, k, -2], self.ids[leaf, k] = np.inf, -1

    def within(self, row: int, u: float) -> np.ndarray:
        """Segments where the row may cost u (of the unit ball) or less."""
        rows, n = self.rows, self.leaves
        unit = rows.unit[row]
        reach = self.most[:n] + u
        reach *= reach
        reach += 4 * rows.slack
        reach *= 0.25
        leaves = (from_point(self.low[:, :n], self.high[:, :n], unit.astype(rows.kind)) <= reach).nonzero()[0]
        ask = np.array([*(-2 * unit).tolist(), 1.0, -u / 2], rows.kind)
        at = (self.features.take(leaves, axis=0).reshape(-1, len(ask)) @ ask <= u * u / 4 - rows.size[row] + rows.slack).nonzero()[0]
        return self.ids[leaves[at // SIZE], at % SIZE]
