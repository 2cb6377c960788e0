"""Tiles of several blocks: sums, forests and trees as over all pairs."""

import numpy as np
import pandas as pd
import pytest

from quarry.operators import cluster_metrics as M
from quarry.operators import graph as G


def _points(n, seed=1, dim=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, dim))
    x[5] = x[17]  # a copy
    x[9] = 0.0
    return np.arange(n) * 3, x


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)


def test_tile_sums_in_blocks(small_blocks):
    ids, x = _points(90)
    cl = ids % 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pair = {"a_id": ids[:50], "a_v": list(x[:50]), "a_cl": cl[:50]}
    rows = [pair | {"s_tile": 0, "t_tile": 1, "b_id": ids[50:], "b_v": list(x[50:]), "b_cl": cl[50:]},
            pair | {"s_tile": 0, "t_tile": 0, "b_id": ids[:50], "b_v": list(x[:50]), "b_cl": cl[:50]}]
    parts = list(M._tile_sums([pd.DataFrame(rows)]))
    assert max(map(len, parts)) <= 16 * 4  # a block's sums leave the task at once
    got = pd.concat(parts).groupby(["id", "other"])[["s", "c"]].sum()
    for i in range(50):
        for c in range(4):
            m = (cl == c) & (ids != ids[i])
            assert np.allclose(got.loc[(ids[i], c)], (d[i, m].sum(), m.sum()), atol=1e-6)


@pytest.mark.parametrize("threshold", [0.35, 0.8, 0.97, -0.5])
def test_pair_forest_spans_the_components(small_blocks, monkeypatch, threshold):
    ids, x = _points(120)
    n = np.linalg.norm(x, axis=1)
    cos = (x @ x.T) / np.where(n > 0, n, 1)[:, None] / np.where(n > 0, n, 1)[None]
    work = []
    near = G._near
    monkeypatch.setattr(G, "_near", lambda a, b, t: work.append(len(a) * len(b)) or near(a, b, t))
    for a, b in ((ids[:70], ids[70:]), (ids, ids)):
        ia, ib = a // 3, b // 3
        lo, hi, w = G.pair_forest(a, x[ia], b, x[ib], threshold, "cosine")
        assert (lo < hi).all() and np.allclose(w, cos[lo // 3, hi // 3]) and (w >= threshold).all()
        whole, part = G.Forest(120), G.Forest(120)
        u, v = np.nonzero(cos[np.ix_(ia, ib)] >= threshold)
        whole.join(ia[u], ib[v])
        assert part.join(lo // 3, hi // 3).all()  # no edge too many
        assert (whole.parent == part.parent).all()
    if threshold == 0.35:
        assert sum(work) < (70 * 50 + 120 * 120) / 2  # points of one component do not meet


def test_tiles_grow_with_the_bucket(spark):
    df = spark.range(5000).selectExpr("id", "array(double(id)) v")
    sizes = G.tile_pairs(df, "id", "v", None, 100).selectExpr("_tiles").distinct().collect()
    assert [r[0] for r in sizes] == [16]
