"""One vec_id repeated more than k times takes one place among the neighbours."""

import numpy as np
import pytest

from strandline.llm import ann


@pytest.mark.parametrize("block", [ann.BLOCK, 40])
def test_an_id_repeated_more_than_k_times_counts_once(spark, block):
    x = np.random.default_rng(3).standard_normal((121, 8))
    hot = [(1, (x[0] * (3 + 0.01 * i)).tolist()) for i in range(90)]  # the nearest of all to query 0
    rows = [(i, x[i].tolist()) for i in range(121) if i != 1]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows + hot, "vec_id bigint, embedding array<double>"), block=block, quantile=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(range(0, 121, 20)) and got[0][0] == 1
    for q, ids in got.items():
        best = {}
        for i, v in rows + hot:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(x[q], v)))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert len(ids) == len(set(ids)) == 20 and len(set(ids) & set(want)) >= 18
