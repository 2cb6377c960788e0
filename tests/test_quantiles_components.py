"""Histogram selection and spanning forests against numpy."""

import numpy as np
import pytest

from quarry.operators import graph as G
from quarry.operators import quantiles as Q


@pytest.mark.parametrize("few", [2000, 4])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BUCKETS", 8)
    rng = np.random.default_rng(few)
    groups = {"a": rng.normal(0, 1, 301), "b": np.full(500, 3.5), None: np.round(rng.exponential(2, 77), 1), "one": np.array([7.0]),
              "wide": np.array([-1e307, 1e307, 0.0, 1e-300, 5e-324, 1e300, 2.0, 2.0, 2.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.05, 0.3, 0.5, 0.95]
    got = {r.g: r for r in Q.exact_quantiles(df, "x", probs, by="g", names=list("pqrst")).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k].n == len(v)
        want = np.quantile(v, probs)
        assert np.allclose([got[k][c] for c in "pqrst"], want, rtol=1e-12, equal_nan=True), k
    whole = Q.exact_quantiles(df.where("g = 'a'"), "x", [0.25]).collect()[0]
    assert np.isclose(whole["q_0_25"], np.quantile(groups["a"], 0.25))
    assert Q.exact_quantiles(df.where("false"), "x", [0.5]).count() == 0


def test_forest_keeps_the_components():
    rng = np.random.default_rng(1)
    for p in (0.0, 0.02, 0.1, 0.9):
        hit = rng.random((40, 50)) < p
        x, y = G.spanning_forest(hit)
        assert hit[x, y].all()

        def comps(a, b):
            lab = np.arange(90)
            for _ in range(90):
                for i, j in zip(a, b + 40):
                    lab[i] = lab[j] = min(lab[i], lab[j])
            return lab
        full, small = comps(*np.nonzero(hit)), comps(x, y)
        assert (full == small).all() and len(x) == 90 - len(set(full))


def test_components_by_shuffle_and_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    e = [(0, i) for i in range(1, 300)] + [(int(a), int(a) + 1) for a in range(400, 450)] + [(int(a), int(b)) for a, b in rng.integers(500, 600, (60, 2))]
    edges = spark.createDataFrame(e, "src long, dst long")
    nodes = spark.range(650)
    one = {r.id: r.comp for r in G.components(nodes, edges).collect()}
    lab = list(range(650))
    for _ in range(120):
        for a, b in e:
            lab[a] = lab[b] = min(lab[a], lab[b])
    assert one == dict(enumerate(lab))
    monkeypatch.setattr(G, "SMALL_ROWS", 0)
    assert {r.id: r.comp for r in G.components(nodes, edges).collect()} == one
