"""Blocks of rows and segments: what they leave out can't matter, and a step of a tour looks at few of the rows."""

import numpy as np
import pytest

from strandline.operators import boxes, routes, tours


def points(seed, n, d):
    return np.random.default_rng(seed).standard_normal((n, d))


@pytest.mark.parametrize("d", [1, 2, 6])
def test_lists_give_the_nearest_row_that_is_left(d):
    x = np.round(points(d, 700, d), 1)
    rows, order = boxes.Rows(x), np.random.default_rng(1).permutation(700)
    lists, left = boxes.Lists(rows, np.arange(700)), np.ones(700, bool)
    for row in order[:650]:
        lists.take(int(row))
        left[row] = False
        for asks in (row, order[0]):
            far = np.where(left, rows.between(np.full(700, asks), np.arange(700)), np.inf)
            assert lists.first(int(asks)) == (int(far.argmin()), far.min())


def test_segments_where_a_row_may_cost_as_much_are_found():
    x = np.concatenate([points(3, 500, 3), np.zeros((200, 3))])
    rows = boxes.Rows(x)
    path = routes.Path(rows, 0, 1)
    for node in range(2, 690):
        path.insert(node, int(np.random.default_rng(node).integers(path.count)))
    for node in range(690, 700):
        cost = path.cost(node, np.arange(path.count))
        for u in np.quantile(cost, [0, 0.01, 0.3]):
            assert set(np.flatnonzero(cost <= u)) <= set(path.segments.within(node, max(0.0, u) / rows.radius).tolist())


@pytest.mark.parametrize("method", tours.METHODS)
def test_paths_of_random_tables(method):
    rng = np.random.default_rng(4)
    for k in range(12):
        x = points(k, int(rng.integers(3, 150)), int(rng.integers(1, 9)))
        x = np.round(x, 1) if k % 2 else x * 1e3
        assert routes.route(x, method) == tours.open_path(x, method)


@pytest.mark.parametrize("method", ["nn", "two_opt"])
def test_a_step_looks_at_few_rows(method, monkeypatch):
    seen = []
    taken = boxes.Boxes.taken
    monkeypatch.setattr(boxes.Boxes, "taken", lambda self, blocks: seen.append(len(blocks) * boxes.SIZE) or taken(self, blocks))
    work = []
    for n in (2_000, 8_000):
        seen.clear()
        assert sorted(routes.route(points(9, n, 2), method)) == list(range(n))
        work.append(sum(seen))
    assert work[1] < 8 * work[0]  # 16 times, were all rows that are left looked at


@pytest.mark.parametrize("method", ["farthest_insertion", "nearest_insertion", "cheapest_insertion"])
def test_a_step_looks_at_few_segments(method, monkeypatch):
    seen, within = [], boxes.Segments.within

    def counted(self, row, u):
        got = within(self, row, u)
        seen.append(len(got))
        return got

    monkeypatch.setattr(boxes.Segments, "within", counted)
    assert sorted(routes.route(points(9, 3_000, 2), method)) == list(range(3_000))
    assert np.mean(seen) < 30
