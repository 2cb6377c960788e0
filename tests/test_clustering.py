"""Clustering against numpy brute force."""

import numpy as np

from quarry.operators import density as D
from quarry.operators import graph as G
from quarry.operators.kmeans import kmeans


def _prim(X):
    n = len(X)
    D2 = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    seen = np.zeros(n, bool)
    seen[0] = True
    best = D2[0].copy()
    frm = np.zeros(n, int)
    edges = []
    for _ in range(n - 1):
        cand = np.where(seen, np.inf, best)
        j = int(np.argmin(cand))
        edges.append((min(frm[j], j), max(frm[j], j), best[j]))
        seen[j] = True
        upd = D2[j] < best
        frm[upd] = j
        best = np.minimum(best, D2[j])
    return edges


def _same_partition(a: dict, b: dict) -> bool:
    pairs = {}
    for k in a:
        if a[k] == -1 or b[k] == -1:
            if a[k] != b[k]:
                return False
            continue
        if pairs.setdefault(a[k], b[k]) != b[k]:
            return False
    return len(set(pairs.values())) == len(pairs)


def test_mst_weight_and_density_labels(spark):
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.normal(0, 0.3, (25, 5)), rng.normal(3, 0.3, (25, 5)),
                        rng.uniform(-6, 9, (10, 5))])
    df = spark.createDataFrame([(i, "b", X[i].tolist()) for i in range(len(X))],
                               ["id", "bucket", "v"])
    mst = D.euclidean_mst(df, "id", "v", "bucket", tile_size=16).toPandas()
    ref = _prim(X)
    assert len(mst) == len(X) - 1
    assert np.isclose(mst["d"].sum(), sum(e[2] for e in ref))
    ids = np.arange(len(X))
    got = D.condense_labels(ids, mst["u"].to_numpy(), mst["v"].to_numpy(), mst["d"].to_numpy())
    r = np.array(ref)
    want = D.condense_labels(ids, r[:, 0].astype(int), r[:, 1].astype(int), r[:, 2])
    assert _same_partition(got, want)
    labs = D.density_cluster(df, "id", "v", "bucket").toPandas()
    assert len(labs) == len(X) and (labs["cluster"] >= 0).any()


def test_condense_two_blobs():
    # two tight pairs far apart: two clusters, nothing is noise
    ids = np.array([0, 1, 2, 3])
    u = np.array([0, 2, 1])
    v = np.array([1, 3, 2])
    d = np.array([0.1, 0.1, 5.0])
    lab = D.condense_labels(ids, u, v, d)
    assert lab[0] == lab[1] and lab[2] == lab[3] and lab[0] != lab[2] and lab[0] >= 0


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)],
                                  ["src", "dst"])
    nodes = spark.createDataFrame([(i,) for i in list(range(41)) + [100, 101, 200]], ["id"])
    got = {r["id"]: r["comp"] for r in G.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert got[100] == got[101] == 100 and got[200] == 200


def test_kmeans_partition(spark):
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(40)], ["id", "v"])
    out, _ = kmeans(df, "v", k=2, seed=42)
    labs = [r["cluster"] for r in out.orderBy("id").collect()]
    assert len(set(labs[:20])) == 1 and len(set(labs[20:])) == 1 and labs[0] != labs[20]


def test_cumulative_agreement_last_window_is_global(spark):
    import __spark_entry__ as se
    from tests.conftest import SF_MID
    q = se.queries()
    cum = q["cumulative_agreement"](spark, SF_MID).orderBy("window").collect()[-1].asDict()
    glob = q["cluster_agreement"](spark, SF_MID).first().asDict()
    cum.pop("window")
    assert cum == glob
