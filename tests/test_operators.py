"""Operator tests on hand-made rows plus metamorphic / brute-force checks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster_metrics as M
from quarry.operators import sampling as SM
from quarry.operators.overlap import _lcs_len, python_bleu, score_pairs
from quarry.operators.quantiles import exact_quantiles
from quarry.operators.trigger import ema


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], ["v"])
    q = exact_quantiles(df, "v", [0.05, 0.3, 0.95], names=["a", "b", "c"]).first()
    assert math.isclose(q["a"], 1.15) and math.isclose(q["b"], 1.9) and math.isclose(q["c"], 8.95)


def test_percentiles_grouped_match_numpy(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.random()) for g in ("a", "b", "c") for _ in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, ["g", "v"])
    got = {r["g"]: (r["q1"], r["q2"]) for r in
           exact_quantiles(df, "v", [0.05, 0.95], by="g", names=["q1", "q2"]).collect()}
    for g in ("a", "b", "c"):
        vals = [v for k, v in rows if k == g]
        assert np.allclose(got[g], np.percentile(vals, [5, 95]))


def test_ema(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], ["k", "t", "x"])
    got = [r["e"] for r in ema(df, "x", "t", by="k", alpha=0.1, out="e").orderBy("t").collect()]
    assert np.allclose(got, [0.1, 0.29])


def test_ema_chunked_equals_sequential(spark):
    rnd = random.Random(5)
    rows = [(k, t, rnd.random()) for k in range(2) for t in range(700)]
    df = spark.createDataFrame(rows, ["k", "t", "x"])
    got = {(r["k"], r["t"]): r["e"] for r in
           ema(df, "x", "t", by="k", out="e", chunk_rows=300).collect()}
    for k in range(2):
        e = 0.0
        for t in range(700):
            e = 0.9 * e + 0.1 * rows[k * 700 + t][2]
            assert abs(got[(k, t)] - e) < 1e-9


@pytest.mark.parametrize("alpha", [1e-3, 0.9, 1.0])
def test_ema_of_any_memory(spark, alpha):
    rnd = random.Random(6)
    rows = [(k, t, rnd.uniform(-5, 5)) for k, n in (("a", 400), (None, 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    got = {(r["k"], r["t"]): r["e"] for r in ema(df, "x", "t", by="k", alpha=alpha, out="e", chunk_rows=60).collect()}
    last = {}
    for k, t, x in rows:
        last[k] = (1 - alpha) * last.get(k, 0.0) + alpha * x
        assert abs(got[(k, t)] - last[k]) < 1e-9


def test_ari_relabel(spark):
    rows = [(i, i % 3, (i % 3) + 10) for i in range(30)]
    df = spark.createDataFrame(rows, ["id", "t", "p"])
    r = M.agreement(df, "t", "p").first()
    assert math.isclose(r["ari"], 1.0) and math.isclose(r["nmi"], 1.0)


def test_ari_known_value(spark):
    # sklearn.metrics.adjusted_rand_score([0,0,1,1],[0,0,1,2]) = 0.5714285714285715
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], [0, 0, 1, 2])), ["t", "p"])
    r = M.agreement(df, "t", "p").first()
    assert math.isclose(r["ari"], 0.5714285714285715)


def test_silhouette_brute_force(spark):
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(60, 4))
    lab = rnd.integers(0, 3, size=60)
    df = spark.createDataFrame([(i, int(lab[i]), X[i].tolist()) for i in range(60)],
                               ["id", "cl", "v"])
    got = M.silhouette(df, "id", "cl", "v", tile_size=16).first()["silhouette"]
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(60):
        own = (lab == lab[i]) & (np.arange(60) != i)
        if own.sum() == 0:
            s.append(0.0)
            continue
        a = D[i, own].mean()
        b = min(D[i, lab == c].mean() for c in set(lab.tolist()) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(got, float(np.mean(s)), rel_tol=1e-9)


def test_lcs_matches_dp():
    rnd = random.Random(1)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j],
                                                                                dp[i][j - 1])
        assert _lcs_len(a, b) == dp[len(a)][len(b)]


def test_score_pairs_bleu_matches_python(spark):
    pairs = [(1, "the cat sat on the mat today", "the cat is on the mat"),
             (2, "a b c d e", "a b c d e"), (3, "x y", "p q r"), (4, "", "a b")]
    df = spark.createDataFrame(pairs, ["k", "pred", "gold"])
    got = {r["k"]: r for r in score_pairs(df, "k", "pred", "gold").collect()}
    for k, p, g in pairs:
        assert math.isclose(got[k]["bleu4"], python_bleu(p, g), abs_tol=1e-12)
        assert math.isclose(got[k]["bleu1"], python_bleu(p, g, (1, 0, 0, 0)), abs_tol=1e-12)
    assert math.isclose(got[2]["rougeL"], 1.0) and math.isclose(got[2]["rouge1"], 1.0)


def test_group_rank_matches_row_number(spark):
    from pyspark.sql import Window
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 5)}", i, rnd.random())
            for i in range(3000)]
    df = spark.createDataFrame(rows, ["g", "id", "v"])
    r = SM.group_rank(df, "g", ["v", "id"], "rk", "n", partitions=16)
    w = Window.partitionBy("g").orderBy("v", "id")
    bad = r.withColumn("rn", F.row_number().over(w)).filter("rk != rn").count()
    assert bad == 0 and r.count() == 3000


def test_diversity_interval(spark):
    df = spark.createDataFrame([(i, i, "c") for i in range(1, 11)], ["id", "len", "g"])
    got = sorted(r["len"] for r in SM.diversity_sample(df, "g", "len", "id", 3).collect())
    assert got == [1, 4, 7]


def test_holdout_small(spark):
    df = spark.createDataFrame([(i, "c") for i in range(3)], ["id", "g"])
    got = [r["split"] for r in SM.holdout(df, "g", "id").collect()]
    assert got.count("val") == 1 and got.count("train") == 2


def test_splits_disjoint_complete(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(400)], ["id", "g"])
    s = SM.stratified_split(df, "g", "id")
    assert s.count() == 400 and s.select("id").distinct().count() == 400
    per = {(r["g"], r["split"]): r["count"] for r in s.groupBy("g", "split").count().collect()}
    assert per[(0, "test")] == 10 and per[(0, "val")] == 9


def test_metrics_invariant_under_permutation(spark):
    from quarry.operators.metrics import binary_metrics
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(300)]
    a = spark.createDataFrame(rows, ["id", "y", "p"])
    b = spark.createDataFrame(list(reversed(rows)), ["id", "y", "p"]).repartition(7)
    ra, rb = binary_metrics(a, "y", "p").first(), binary_metrics(b, "y", "p").first()
    assert ra.asDict() == rb.asDict()


def test_ari_nmi_symmetric(spark):
    rnd = random.Random(12)
    rows = [(rnd.randint(0, 4), rnd.randint(0, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, ["t", "p"])
    r1 = M.agreement(df, "t", "p").first()
    r2 = M.agreement(df, "p", "t").first()
    assert math.isclose(r1["ari"], r2["ari"]) and math.isclose(r1["nmi"], r2["nmi"])
    assert math.isclose(r1["homogeneity"], r2["completeness"])


def test_balance_gives_equal_classes(spark):
    rows = [(i, "a" if i % 5 else "b") for i in range(500)]
    df = spark.createDataFrame(rows, ["id", "lab"])
    out = SM.balance(df, "lab", "id", seed=7)
    counts = {r["lab"]: r["count"] for r in out.groupBy("lab").count().collect()}
    assert counts == {"a": 100, "b": 100}
    again = {r["id"] for r in SM.balance(df, "lab", "id", seed=7).collect()}
    assert again == {r["id"] for r in out.collect()}  # seeded: the same draw


def test_group_rank_keeps_null_groups(spark):
    rows = [(None if i % 3 == 0 else "g", i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, id long")
    r = SM.group_rank(df, "g", ["id"], "rk", "n")
    got = {(x["g"], x["rk"]) for x in r.collect()}
    assert r.count() == 30 and (None, 10) in got and ("g", 20) in got


def test_running_total_null_groups(spark):
    from quarry.operators.indexing import running_total
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("a", 1, 5)], "g string, o long, v long")
    got = {(r["g"], r["o"]): r["cum_v"] for r in running_total(df, ["o"], ["v"], by="g").collect()}
    assert got == {(None, 1): 1, (None, 2): 3, ("a", 1): 5}


@pytest.mark.parametrize("n, due", [(0, 0), (1, 0), (2, 1), (10, 45), (100, 1000)])
def test_sample_pairs_reaches_its_count(spark, n, due):
    from quarry.operators.buffer_ops import sample_pairs
    df = spark.range(n).selectExpr("id AS vec_id", "array(1.0D, double(id)) AS embedding")
    got = [(r.i, r.j) for r in sample_pairs(df, "vec_id", "embedding").collect()]
    assert len(got) == len(set(got)) == due
    assert all(0 <= i < j < n for i, j in got)


def test_buffer_occupancy_counts_null_ids(spark):
    from quarry.operators.buffer_ops import buffer_occupancy
    df = spark.createDataFrame([("a", -1), ("a", None), ("a", 0), (None, 2)], "bucket string, cluster_id int")
    got = {r.bucket: (r.buffered, r.assigned) for r in buffer_occupancy(df).collect()}
    assert got == {"a": (2, 1), None: (0, 1)}


def test_pool_chunks_is_the_mean(spark):
    from quarry.operators.buffer_ops import pool_chunks
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "s int, embedding array<double>")
    got = {r.s: (list(r.embedding), r.n_chunks) for r in pool_chunks(df, "s").collect()}
    assert got == {1: ([2.0, 4.0], 2), 2: ([5.0, 5.0], 1)}


def test_assign_nearest_returns_every_sample(spark):
    from quarry.operators.centroids import assign_nearest
    s = spark.createDataFrame(
        [(1, "a", [1.0, 0.0], ["x"]), (2, None, [1.0, 0.0], ["x"]), (3, "lone", [0.0, 1.0], []),
         (4, "a", [0.0, 1.0], None)],
        "sample_id long, bucket string, embedding array<double>, keywords array<string>")
    c = spark.createDataFrame(
        [("a", 7, [1.0, 0.0], ["x"]), ("a", 8, [0.0, 1.0], ["y"]), (None, 9, [1.0, 0.0], ["x"])],
        "bucket string, cluster_id long, centroid array<double>, keywords array<string>")
    got = {r.sample_id: (r.bucket, r.assigned_cluster, r.match_score) for r in assign_nearest(s, c).collect()}
    assert got[2] == (None, None, None) and got[3] == ("lone", None, None)
    assert got[1][:2] == ("a", 7) and got[1][2] == 1.0
    assert got[4][:2] == ("a", 8) and abs(got[4][2] - 0.7) < 1e-12 and len(got) == 4


def test_assign_nearest_in_blocks_against_all_pairs(spark, monkeypatch):
    import numpy as np

    from quarry.operators import nearest
    from quarry.operators.centroids import assign_nearest
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 400)
    monkeypatch.setattr(nearest, "SMALL", 0)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    s = [(i, "ab"[i % 2], rng.normal(0, 1, 4).tolist() if i % 7 else None, rng.choice(words, 3).tolist()) for i in range(90)]
    c = [("ab"[i % 2], i, (rng.normal(0, 1, 4) * (i != 4)).tolist(), rng.choice(words, 1 + i % 5).tolist()) for i in range(40)]
    got = {r.sample_id: (r.assigned_cluster, r.match_score) for r in assign_nearest(
        spark.createDataFrame(s, "sample_id long, bucket string, embedding array<double>, keywords array<string>"),
        spark.createDataFrame(c, "bucket string, cluster_id long, centroid array<double>, keywords array<string>")).collect()}

    def score(v, kw, cv, ck):
        a, b = np.array(v), np.array(cv)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return 0.7 * (a @ b / n if n else 0.0) + 0.3 * len(set(kw) & set(ck)) / len(set(ck))

    for i, b, v, kw in s:
        if v is None:
            assert got[i] == (None, None)
            continue
        best = max((score(v, kw, cv, ck), -cid) for cb, cid, cv, ck in c if cb == b)
        assert got[i][0] == -best[1] and abs(got[i][1] - best[0]) < 1e-9


def test_assign_to_centroids_in_blocks(spark):
    from quarry.operators.centroids import assign_to_centroids
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(30)], "id long, embedding array<double>")
    cents = spark.createDataFrame([(k, [k * 0.7, 2.0 - k * 0.3]) for k in range(6)], "cluster_id long, centroid array<double>")
    for metric in ("cosine", "sqeuclidean"):
        one, many = ({r.id: r.pred for r in assign_to_centroids(df, cents, metric=metric, most_bytes=n).collect()} for n in (1 << 20, 100))
        assert one == many and len(one) == 30
