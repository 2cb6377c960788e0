"""The sliced cluster tree against the local one."""

import numpy as np
import pytest

from quarry.operators import density as D
from quarry.operators.dendrogram import density_labels
from tests.test_clustering import _prim, _same_partition


def _bucket(rng, n, same=False):
    x = np.concatenate([rng.normal(c, 0.3 + 0.2 * c, (n // 3, 3)) for c in (0, 2, 5)])
    if same:  # groups of equal points: distances of 0
        x[:6] = x[0]
        x[40:43] = x[50]
    return _prim(x)


@pytest.mark.parametrize("size,least", [(1000, 2), (30, 2), (30, 4)])
def test_slices_give_the_local_tree(spark, size, least):
    rng = np.random.default_rng(size + least)
    rows, want = [], {}
    for b, off, n, same in (("x", 0, 60, False), (None, 1000, 90, True)):
        e = _bucket(rng, n, same)
        rows += [(b, int(u) + off, int(v) + off, float(d)) for u, v, d in e]
        r = np.array(e)
        lab = D.condense_labels(np.arange(n), r[:, 0].astype(int), r[:, 1].astype(int), r[:, 2], least)
        if len({c for c in lab.values() if c >= 0}) > 1:
            want[b] = {k + off: c for k, c in lab.items()}
    mst = spark.createDataFrame(rows, "bucket string, u long, v long, d double")
    got = {}
    for r in density_labels(mst, ["bucket"], least, size).collect():
        got.setdefault(r.bucket, {})[r.id] = r.cluster
    assert got.keys() == want.keys()
    for b in got:
        assert got[b].keys() == want[b].keys() and _same_partition(got[b], want[b])
        firsts = [min(i for i, c in got[b].items() if c == k) for k in range(max(got[b].values()) + 1)]
        assert firsts == sorted(firsts)


def test_tiles_give_one_tree(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (120, 2)).astype(float)  # many equal distances and points
    df = spark.createDataFrame([(i, "b" if i % 2 else None, x[i].tolist()) for i in range(120)], "id long, bucket string, v array<double>")
    one = {tuple(r) for r in D.euclidean_mst(df, "id", "v", "bucket").collect()}
    many = {tuple(r) for r in D.euclidean_mst(df, "id", "v", "bucket", tile_size=16).collect()}
    assert one == many and len(one) == 118
    assert D.euclidean_mst(df.where("false"), "id", "v", "bucket").count() == 0
    assert D.density_cluster(df.where("id < 20"), "id", "v").count() == 0


def test_a_long_component_is_contracted(spark):
    """The first slices make one path of 1,500 points, far longer than any number of rounds."""
    rng = np.random.default_rng(4)
    n = 2000
    ids = rng.permutation(n)
    d = np.where(np.arange(n - 1) < 1500, rng.random(n - 1), 2 + rng.random(n - 1))
    u, v = np.minimum(ids[:-1], ids[1:]), np.maximum(ids[:-1], ids[1:])
    mst = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), d.tolist())), "u long, v long, d double")
    got = {r.id: r.cluster for r in density_labels(mst, [], 2, 500).collect()}
    want = D.condense_labels(np.arange(n), u, v, d)
    assert got.keys() == want.keys() and _same_partition(got, want)
