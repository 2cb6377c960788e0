"""Trees of buckets that fit one task: as by rounds and slices, in few jobs."""

import numpy as np
import pytest

from quarry.operators import density as D
from quarry.operators.dendrogram import density_labels
from quarry.plans.stream_plans import triggered_stream
from tests.test_clustering import _prim

SCHEMA = "id long, bucket string, v array<double>"


def _rows(n=240):
    x = np.random.default_rng(3).integers(0, 7, (n, 2)).astype(float)  # many equal distances and points
    names = ["a"] * 6 + [None] * 3 + ["c"]
    return [(i, names[i % 10], x[i].tolist()) for i in range(n)]


def _jobs(spark):
    return spark._jsc.sc().dagScheduler().numTotalJobs()


def test_last_edges_in_one_task_give_the_tree_of_rounds(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    want = {tuple(r) for r in D.euclidean_mst(df, "id", "v", "bucket").collect()}
    assert len(want) == 237
    for last in (0, 150, 1000):  # rounds only, some buckets after some rounds, no round
        assert {tuple(r) for r in D.euclidean_mst(df, "id", "v", "bucket", tile_size=16, last=last).collect()} == want
    one = D.euclidean_mst(df.drop("bucket"), "id", "v", tile_size=32, last=300).collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in D.euclidean_mst(df.drop("bucket"), "id", "v").collect()}


@pytest.mark.parametrize("least", [2, 4])
def test_slices_and_single_tasks_side_by_side(spark, least):
    rng = np.random.default_rng(least)
    rows = []
    for b, off, n in (("x", 0, 90), (None, 1000, 60), ("y", 2000, 30)):
        x = np.concatenate([rng.normal(c, 0.3 + 0.2 * c, (n // 3, 3)) for c in (0, 2, 5)])
        x[:4] = x[0]
        rows += [(b, int(u) + off, int(v) + off, float(d)) for u, v, d in _prim(x)]
    mst = spark.createDataFrame(rows, "bucket string, u long, v long, d double")
    got = [{tuple(r) for r in density_labels(mst, ["bucket"], least, size).collect()} for size in (1000, 50, 20)]
    assert got[0] == got[1] == got[2] and len({r[0] for r in got[0]}) == 3
    alone = mst.where("bucket = 'x'").drop("bucket")
    assert {tuple(r) for r in density_labels(alone, [], least).collect()} == {r[1:] for r in got[0] if r[0] == "x"}
    assert density_labels(mst.where("false"), ["bucket"]).count() == 0


def test_density_of_small_buckets_takes_few_jobs(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    before = _jobs(spark)
    D.density_cluster(df, "id", "v", "bucket", tile_size=32).collect()
    assert _jobs(spark) - before < 50


def test_only_triggered_rows_get_keywords(spark):
    rows = triggered_stream(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert 0 <= plan.index("array_sort") < plan.index("Join")


def test_matches_of_common_words_come_in_parts():
    import tracemalloc

    from quarry.operators import nearest as N
    rng = np.random.default_rng(0)
    rows, n, common = 512, 400, 100
    tile = {"unit": {}, "vecs": rng.normal(0, 1, (rows, 4)).tolist(), "words": np.tile(np.arange(common), rows),
            "row": np.repeat(np.arange(rows), common)}
    x = N._unit(rng.normal(0, 1, (n, 4)).tolist(), 4)
    sizes = rng.integers(1, common, n)
    words = np.concatenate([np.sort(rng.permutation(common)[:k]) for k in sizes])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(words, kind="stable")
    r = {"n": n, "width": 4, "cids": np.arange(n).tobytes(), "x": x.tobytes(), "centre": x[0].tobytes(), "wide": np.pi,
         "sizes": sizes.tobytes(), "words": words[order].tobytes(), "owner": owner[order].tobytes()}
    best = np.full(rows, -np.inf), np.zeros(rows, dtype=np.int64)
    tracemalloc.start()
    N._visit(tile, best, r, 0.7, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = 0.7 * (N._unit(tile["vecs"], 4) @ x.T) + 0.3  # every word is a row's word
    assert np.allclose(best[0], want.max(1)) and (best[1] == want.argmax(1)).all()
    assert peak < 100 << 20  # 10 million matches of several numbers
