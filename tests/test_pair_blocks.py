"""Pairs by blocks: every pair of blocks a task of its own, few copies of the rows, a strip of pairs at a time, and distances rounded as SQL rounds them."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandline.operators import tours

from .oracle import SF, connection, same


def frame(spark, x, ids=None, kind="long"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], f"id {kind}, x array<double>")


def test_rows_are_copied_to_a_bounded_number_of_blocks(spark, monkeypatch):
    data = spark.range(500).selectExpr("id", "array(double(id)) AS x")
    rows = tours.in_block_pairs(data, 40, 500)
    assert rows.rdd.getNumPartitions() == 13 * 14 // 2  # a partition for each pair of blocks, and Spark doesn't join them
    assert tours.in_block_pairs(data, 2048, 615_600).rdd.getNumPartitions() == tours.BLOCKS * (tours.BLOCKS + 1) // 2  # of 301 blocks before
    assert tours.in_block_pairs(data, 2048, 10**9).rdd.getNumPartitions() == tours.TASKS
    monkeypatch.setattr(tours, "BLOCKS", 4)
    assert rows.count() == 500 * 13 and tours.in_block_pairs(data, 40, 500).count() == 500 * 4
    monkeypatch.setattr(tours, "LARGEST", 100)
    assert tours.in_block_pairs(data, 40, 500).count() == 500 * 5  # blocks that are large enough don't grow


@pytest.mark.parametrize("one_block", [True, False])
def test_pairs_leave_a_strip_at_a_time(one_block):
    rng = np.random.default_rng(3)
    x, own = rng.standard_normal((300, 4)), np.zeros(300, int) if one_block else rng.integers(0, 2, 300)
    ids = rng.permutation(1000)[:300]
    t = pa.table({"a": [0] * 300, "b": [0 if one_block else 1] * 300, "own": own, "id": ids, "x": pa.array(x.tolist())})
    strips = list(tours.pairs_across(t, cells=1000))
    assert len(strips) > 20 and all(len(i) == len(j) == len(d) <= 1000 for i, j, d in strips)
    got = {(int(i), int(j)): v for s in strips for i, j, v in zip(*s)}
    d = tours.distances(x)
    want = {(int(ids[p]), int(ids[q])): d[p, q] for p in range(300) for q in range(300) if ids[p] > ids[q] and (one_block or own[p] != own[q])}
    assert got == want and sum(len(s[0]) for s in strips) == len(want)


def test_ids_of_other_types_and_few_rows(spark):
    x, ids = np.random.default_rng(4).standard_normal((60, 2)), [f"é{i}" if i % 3 else f"Z{i}" for i in range(60)]
    got = {(r["i"], r["j"]): r["distance"] for r in tours.pairwise(frame(spark, x, ids, "string"), block=7).collect()}
    d = tours.distances(x)
    assert got == {(ids[p], ids[q]): d[p, q] for p in range(60) for q in range(60) if ids[p] > ids[q]}
    for n in (0, 1, 2):
        assert tours.pairwise(frame(spark, x[:n])).count() == n * (n - 1) // 2


def test_distances_are_rounded_as_sql_rounds(spark):
    rng = np.random.default_rng(5)
    halves = (np.arange(20_000) + 0.5) / 1e4
    values = np.concatenate([rng.random(20_000) * 10.0 ** rng.integers(-6, 14, 20_000), halves, np.nextafter(halves, 0), [0.0, 5e-324, 1e304, 1e308, 4503599627370497 / 1e4]])
    con = duckdb.connect()
    con.register("v", pa.table({"d": values}))
    assert np.array_equal(tours.rounded(values, 4), con.execute("SELECT round(d, 4) AS r FROM v").fetchnumpy()["r"])
    apart = [0.0, *halves[:200]]
    got = {r["i"]: r["distance"] for r in tours.pairwise(frame(spark, [[v] for v in apart]), digits=4).where("j = 0").collect()}
    con.register("w", pa.table({"i": range(201), "d": apart}))
    assert got == dict(con.execute("SELECT i, round(d, 4) FROM w WHERE i > 0").fetchall())


def test_query_is_its_sql(spark):
    from strandline.plans.catalogue import ORACLES, QUERIES

    same(QUERIES["pairwise_distance"](spark, SF), connection(), ORACLES["pairwise_distance"])
