"""Queries without SQL read every row of embeddings, and all eight columns."""

import numpy as np
import pytest

from strandline.operators import tours
from strandline.plans.catalogue import QUERIES
from strandline.sources.matrices import energy_features, read_table

from .oracle import SF

ORDERS = ["tour_farthest_insertion", "tour_nearest_insertion", "tour_cheapest_insertion", "tour_two_opt", "nn_tour"]


@pytest.fixture(scope="module")
def rows(spark):
    got = energy_features(spark, SF).orderBy("id").collect()
    assert len(got) == read_table(spark, SF, "embeddings").count() == 500
    return [r["id"] for r in got], np.array([r["x"] for r in got]), [r["grp"] for r in got]


@pytest.mark.parametrize("name", ORDERS)
def test_orders_hold_every_row(spark, rows, name):
    got = QUERIES[name](spark, SF).collect()
    assert sorted(r["id"] for r in got) == rows[0] and sorted(r["position"] for r in got) == list(range(1, 501))


def test_tours_are_those_of_all_rows(spark, rows):
    ids, x, grp = rows
    got = [r["id"] for r in QUERIES["nn_tour"](spark, SF).orderBy("position").collect()]
    assert got == [ids[i] for i in tours.open_path(x, "nn")]
    grouped = QUERIES["nn_tour_grouped"](spark, SF).orderBy("group", "position").collect()
    for g in set(grp):
        own = [i for i, h in enumerate(grp) if h == g]
        assert [r["id"] for r in grouped if r["group"] == g] == [ids[own[i]] for i in tours.open_path(x[own], "nn")]


def test_selection_takes_all_rows_and_columns(spark, rows):
    _, x, grp = rows
    for name, method in (("factor_selection_nn", "nn"), ("factor_selection_elbow", "farthest_insertion")):
        got = QUERIES[name](spark, SF).orderBy("step").collect()
        assert [r["step"] for r in got] == list(range(1, 9))
        assert got[0]["loss"] == pytest.approx(tours.path_length(x[:, :1], tours.open_path(x[:, :1], method)), abs=1e-4)
    got = QUERIES["factor_selection_grouped"](spark, SF).orderBy("step").collect()
    parts = [x[[i for i, h in enumerate(grp) if h == g], :1] for g in sorted(set(grp))]
    assert len(got) == 8 and got[0]["loss"] == pytest.approx(np.mean([tours.path_length(p, tours.open_path(p, "nn")) for p in parts]), abs=1e-4)


def test_pairs_neighbours_and_heights_of_all_rows(spark, rows):
    ids, x, _ = rows
    d = tours.distances(x)
    got = {(r["i"], r["j"]): r["distance"] for r in QUERIES["pairwise_distance"](spark, SF).collect()}
    assert len(got) == 500 * 499 // 2 and all(abs(got[ids[i], ids[j]] - d[i, j]) < 1e-4 for i in range(500) for j in range(i))
    np.fill_diagonal(d, np.inf)
    near = {(r["id"], r["rank"]): r["distance"] for r in QUERIES["knn_graph"](spark, SF).collect()}
    assert len(near) == 500 * 15 and all(abs(near[i, k + 1] - v) < 1e-4 for i, row in zip(ids, np.sort(d, axis=1)) for k, v in enumerate(row[:15]))
    reach, tree = d[0].copy(), []  # Prim's tree
    reach[0] = np.inf
    seen = np.zeros(500, bool)
    seen[0] = True
    for _ in range(499):
        j = int(np.argmin(np.where(seen, np.inf, reach)))
        tree.append(reach[j])
        seen[j] = True
        reach = np.minimum(reach, d[j])
    heights = sorted(r["height"] for r in QUERIES["merge_heights_single"](spark, SF).collect())
    assert heights == pytest.approx(sorted(tree), abs=1e-4)
