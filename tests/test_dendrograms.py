"""Neighbours by cells, spanning trees, dendrograms and layouts of any number of rows, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.names import every_column, spare
from strandline.operators import cells, embed, graph, linkage, ordering, sampling, tours
from strandline.sources.staging import numbered


def frame(spark, x, ids=None, parts=3):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), np.asarray(v, float).tolist()) for i, v in zip(ids, x)], "id bigint, x array<double>").repartition(parts)


def plain_merges(x, method):
    """Agglomeration by Lance-Williams updates: pairs of lists of rows, with heights."""
    n, d = len(x), tours.distances(x)
    np.fill_diagonal(d, np.inf)
    size, parts, out = np.ones(n), {i: [i] for i in range(n)}, []
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
        h = d[i, j]
        if method == "single":
            new = np.minimum(d[i], d[j])
        else:
            with np.errstate(invalid="ignore"):
                new = np.sqrt(np.maximum(0, ((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * h**2) / (size[i] + size[j] + size)))
        new[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
        a, b = sorted((parts[i], parts.pop(j)), key=min)
        out.append((float(h), min(a), min(b), len(a), len(b)))
        parts[i] = a + b
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return out, parts[0] if n else []


def clustered(seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([c + rng.standard_normal((20, 3)) for c in rng.standard_normal((6, 3)) * 50])
    x[7], x[100], x[110] = x[3], x[3], x[61]  # equal rows
    return x, rng.permutation(1000)[: len(x)]


@pytest.mark.parametrize("method, options", [("single", {"block": 30, "rows": 16, "part": 8}), ("ward", {"last": 40, "rows": 16, "part": 8})])
def test_merges_in_pieces_and_rounds(spark, method, options):
    """Small pieces, parts and ends take the merges through every step; they are those of one task."""
    x, ids = clustered()
    by = np.argsort(ids)
    got = getattr(linkage, method)(frame(spark, x, ids), **options)
    want, order = plain_merges(x[by], method)
    rows = got.orderBy("step").collect()
    np.testing.assert_allclose([r["height"] for r in rows], [w[0] for w in want], atol=1e-9)
    of = {(r["left"], r["right"]): (r["left_size"], r["right_size"]) for r in rows}
    assert of == {(ids[by[a]], ids[by[b]]): (n, m) for _, a, b, n, m in want}
    places = {r["id"]: r["position"] for r in linkage.leaf_places(frame(spark, x, ids), got).collect()}
    assert sorted(places, key=places.get) == [ids[by[i]] for i in order]


def test_few_rows(spark):
    for n in (1, 2):
        for method in ("single", "ward"):
            data = frame(spark, np.arange(2.0 * n).reshape(n, 2))
            assert [tuple(r) for r in embed.hierarchical(data, method).orderBy("id").collect()] == [(i, i + 1.0, i + 1) for i in range(n)]
    same = embed.merges(frame(spark, np.ones((5, 2))), "single").orderBy("step").collect()
    assert [(r["height"], r["left"], r["right"], r["left_size"]) for r in same] == [(0.0, 0, i, i) for i in range(1, 5)]
    with pytest.raises(ValueError):
        embed.merges(same, "complete")
    with pytest.raises(ValueError, match="no rows"):
        embed.merges(frame(spark, np.ones((1, 2))).limit(0), "single")


@pytest.mark.parametrize("rows, part", [(7, 5), (64, 1024)])
def test_neighbours_by_cells(spark, rows, part):
    x = np.random.default_rng(8).integers(0, 4, size=(60, 2)).astype(float)  # many ties and equal rows
    d = tours.distances(x)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in embed.neighbours(frame(spark, x), 4, rows=rows, part=part).collect()}
    assert got == {(i, k + 1): (j, d[i, j]) for i in range(60) for k, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4])}


def test_neighbours_of_few_rows(spark):
    assert embed.neighbours(frame(spark, np.ones((3, 2))).limit(0), 2).collect() == []
    assert {(r["id"], r["rank"], r["neighbour"]) for r in embed.neighbours(frame(spark, np.ones((3, 2))), 5).collect()} == {(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)}


def compared(spark, x, k):
    """The share of all pairs that a search compares."""
    dealt = cells.deal(frame(spark, x), rows=32)
    asks = cells.nearest_asked(dealt, k).groupBy("cell", "part").agg(F.count("*").alias("n"))
    have = dealt.rows.groupBy("cell", "part").agg(F.count("*").alias("m"))
    return asks.join(have, ["cell", "part"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] / len(x) ** 2


def test_cells_leave_out_most_pairs_of_clustered_rows(spark):
    rng = np.random.default_rng(2)
    tight = np.concatenate([c + rng.standard_normal((50, 4)) for c in rng.standard_normal((20, 4)) * 100])
    loose = rng.standard_normal((1000, 4))
    assert compared(spark, tight, 5) < 0.15 and compared(spark, tight, 5) < compared(spark, loose, 5) <= 1


def test_planes_between_pivots_leave_out_cells_of_rows_without_clusters(spark):
    assert compared(spark, np.random.default_rng(2).standard_normal((3000, 4)), 1) < 0.15


@pytest.mark.parametrize("weighted", [False, True])
def test_cells_within_reach_hold_all_rows_that_are_near_enough(weighted):
    rng = np.random.default_rng(6)
    for x in (rng.standard_normal((400, 3)) + 1e5, rng.integers(0, 4, (400, 2)).astype(float), rng.standard_normal((400, 2)) * np.array([1, 1e-9]), np.repeat(rng.standard_normal((20, 2)), 20, axis=0)):
        pivots = np.unique(np.concatenate([x[::9], x[:4] + 1e-9]), axis=0)
        low, high = cells.bounds(x, pivots)
        cell = high.argmin(axis=1)
        reach = np.array([np.sqrt(((x[cell == c] - p) ** 2).sum(axis=1)).max(initial=0) for c, p in enumerate(pivots)])
        counts = np.bincount(cell, minlength=len(pivots))
        dealt = cells.Cells(None, len(x), pivots, counts, counts, reach * (1 + cells.ROUNDING), counts, counts)
        w = rng.uniform(1, 3, (len(x), len(pivots))) if weighted else np.ones((len(x), len(pivots)))
        d = tours.distances(x) * w[:, cell]
        u = np.sort(d, axis=1)[:, 7]
        mask = dealt.within(low, high, u, w if weighted else None)
        assert mask[np.arange(len(x))[:, None], cell][d <= u[:, None]].all()


def test_last_merges_are_those_of_the_least_of_all_pairs():
    """Sizes differ, and many heights are equal."""
    rng = np.random.default_rng(4)
    for x in (rng.standard_normal((90, 3)), rng.integers(0, 4, (80, 2)).astype(float), np.ones((1, 2))):
        n = rng.integers(1, 5, len(x)).astype(float)
        d, size, want = tours.distances(x) * np.sqrt(2 * n[:, None] * n / (n[:, None] + n)), n.copy(), []
        np.fill_diagonal(d, np.inf)
        for _ in range(len(x) - 1):
            i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
            h = d[i, j]
            want.append((i, j, h))
            with np.errstate(invalid="ignore"):
                new = np.sqrt(np.maximum(0, ((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * h**2) / (size[i] + size[j] + size)))
            new[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
            d[i], d[:, i] = new, new
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
        assert list(linkage.ward_merges(x, n)) == want


def test_climbing_sums_the_way_to_the_root(spark):
    links = [(0, 0, 0)] + [(k, k - 1, k) for k in range(1, 40)] + [(50, 50, 0)] + [(100 + k, 50, 7) for k in range(30)]
    got = {r["node"]: (r["up"], r["off"]) for r in graph.climbed(spark.createDataFrame(links, "node bigint, up bigint, off bigint")).collect()}
    assert got == {k: (0, k * (k + 1) // 2) for k in range(40)} | {50: (50, 0)} | {100 + k: (50, 7) for k in range(30)}


def test_numbers_name_the_same_rows_whatever_the_cores(spark, tmp_path):
    spark.range(3000).repartition(24).write.parquet(str(tmp_path / "rows"))
    got = numbered(spark.read.parquet(str(tmp_path / "rows")), "row", "test")
    first = {tuple(r) for r in got.collect()}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")
    try:
        assert {tuple(r) for r in got.collect()} == first and len(first) == 3000
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_helper_columns_have_names_of_their_own(spark):
    df = spark.range(20).select("id", *[F.lit(k).alias(c) for k, c in enumerate(["__rank", "__PART", "__at", "__before", "a.b", "t`c"])])
    assert spare(df, "__part") == "__part_" and df.select(*every_column(df)).columns == df.columns
    plain = df.select("id", "__rank", "__PART", "__at", "__before")
    assert sampling.sample_strata(plain, "__rank", 3).columns == plain.columns
    got = ordering.positions(plain, F.desc("id"))
    assert got.columns == [*plain.columns, "position"] and {(r["id"], r["__rank"], r["__before"], r["position"]) for r in got.collect()} == {(i, 0, 3, 20 - i) for i in range(20)}


# Layouts ---------------------------------------------------------------------------------------------------------------------


def test_gradient_is_that_of_all_pairs(spark):
    """Binned pushes against the sum over all pairs, within a thousandth of the largest push; pulls along edges are exact."""
    rng = np.random.default_rng(3)
    for y in (rng.standard_normal(300) * 20, rng.standard_normal(200) * 1e-4, np.concatenate([np.zeros(50), rng.uniform(0, 3, 50)])):
        edges = [(i, (i + s) % len(y), 0.001 * s) for i in range(len(y)) for s in (1, 2, 5)]
        places = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id bigint, y double")
        got = {r["id"]: r["gradient"] for r in embed.tsne_gradient(places, spark.createDataFrame(edges, "id bigint, neighbour bigint, w double"), 12.0).collect()}
        gap = y[:, None] - y
        w = 1 / (1 + gap**2)
        np.fill_diagonal(w, 0)
        push = (w**2 * gap).sum(axis=1) / w.sum()
        pull = np.zeros(len(y))
        for i, j, p in edges:
            pull[i] += p * w[i, j] * gap[i, j]
        assert np.abs(np.array([got[i] for i in range(len(y))]) - 4 * (12 * pull - push)).max() < 1e-3 * max(np.abs(4 * push).max(), 1e-6)


def test_affinities_and_memberships():
    d = np.sort(np.random.default_rng(1).uniform(0.1, 3, (6, 30)), axis=1)
    d[5, 4:] = np.inf
    p = embed.entropy_affinities(d, 8.0)
    entropy = -np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0).sum(axis=1)
    np.testing.assert_allclose(entropy[:5], np.log(8.0), atol=1e-4)
    assert np.allclose(p.sum(axis=1), 1) and (p[5, 4:] == 0).all()
    m = embed.smooth_memberships(d)
    np.testing.assert_allclose(m[:5].sum(axis=1), np.log2(30), atol=1e-4)
    assert (m[:, 0] == 1).all() and (m[5, 4:] == 0).all()


def test_layouts_follow_a_line(spark):
    t = np.sort(np.random.default_rng(7).uniform(size=120))
    x = np.column_stack([5 * t, np.sin(2 * t)])
    for got in (embed.tsne(frame(spark, x), perplexity=15, rounds=20), embed.umap_axis(frame(spark, x), rounds=10)):
        pos = np.array([r["position"] for r in got.orderBy("id").collect()])
        assert abs(np.corrcoef(pos, np.arange(120))[0, 1]) > 0.9 and sorted(pos) == list(range(1, 121))


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    from strandline.sources import staging

    def names():
        return set(os.listdir(staging.shared_dir(spark) + "/strandline")) if os.path.isdir(staging.shared_dir(spark) + "/strandline") else set()

    before = names()

    def build():
        a, b = (staging.materialise(spark.range(n), "t") for n in (5, 7))
        inner = staging.tidied(spark, lambda: staging.materialise(staging.materialise(spark.range(3), "deep").withColumn("y", F.lit(1)), "inner"))
        b.count()
        return a.join(inner, "id")

    got = staging.tidied(spark, build)
    assert len(names() - before) == 2 and got.count() == 3 and staging._scopes == []

    def folder():
        path = staging.shared_path(spark, "folder")
        spark.range(4).write.parquet(f"{path}/part/deep")
        return spark.read.parquet(f"{path}/part/deep")

    assert staging.tidied(spark, folder).count() == 4  # tables inside a folder keep the folder

    def fails():
        staging.materialise(spark.range(5), "t")
        raise RuntimeError

    held = names()
    with pytest.raises(RuntimeError):
        staging.tidied(spark, fails)
    assert names() == held and staging._scopes == []
    merges = embed.merges(frame(spark, np.random.default_rng(1).standard_normal((30, 2))), "single")
    assert len(names() - held) == 1 and merges.count() == 29
