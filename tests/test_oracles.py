"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as se
from quarry.sources.tables import TABLES
from tests.conftest import SF_SMALL

QUERIES = se.queries()
SQLS = se.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def test_entry(spark):
    df = se.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(SQLS[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    srows = [tuple(r) for r in df.collect()]
    assert _rows(df.columns, srows) == _rows(dcols, drows)


#: Queries without SQL and what their rows on sf0.001 must obey (their own tests
#: compare them with plain versions); a key of None is a result that may be empty here.
KEYS = {
    "kmeans": ("vec_id",), "overlap_report": (), "rouge_stemmed": ("pair_id",), "trigger_full": ("pair_id",),
    "stream_trigger_full": ("pair_id",), "stream_clusters": None, "stream_clusters_merge": None, "stream_warm_start": None,
    "stream_cluster_tables": None, "op1_url_filters": ("page_id",), "op3_secret_scans": ("doc_id",),
    "op4_best_fit_packing": ("doc_id", "piece"), "op5_token_counts": ("doc_id", "section"), "op6_simhash": ("doc_id",),
    "op7_language_id": ("doc_id",), "op8_spotsigs": ("doc_id",), "op9_toxicity": ("doc_id",), "pipeline": None,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS)))
def test_query_without_oracle(spark, name):
    """Known query, unique keys, rows where rows are due, scores in range."""
    keys = KEYS[name]
    df = QUERIES[name](spark, SF_SMALL)
    rows = [r.asDict() for r in df.collect()]
    if "event" in df.columns:  # a sample enters one cluster, once
        ids = [r["sample_id"] for r in rows if r["event"] in ("promoted", "assigned")]
        assert len(ids) == len(set(ids))
    if name == "pipeline":
        used = {}
        for r in rows:
            used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
        assert rows and max(used.values()) <= 1024
    if keys is None:
        return
    assert rows and len({tuple(r[k] for k in keys) for r in rows}) == len(rows)
    for r in rows:
        for c, v in r.items():
            if c.startswith(("rouge", "bleu", "score", "near_", "avg_")) and v is not None:
                assert -1e-9 <= v <= 1 + 1e-9, (c, v)
    if name == "kmeans":
        assert {r["cluster"] for r in rows} <= set(range(5))
