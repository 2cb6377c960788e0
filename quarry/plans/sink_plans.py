"""Sinks, faults and small operators that other queries only carry along:
each query runs the operator and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.plans.cluster_plans import BASE, ncc_members
from quarry.plans.registry import register, rounded
from quarry.plans.trigger_plans import SCORED_CTE, scored_samples
from quarry.session import checkpoint_dir, materialize
from quarry.sources import io as IO
from quarry.sources.tables import embeddings, table


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("vector_snapshots", operators=("SNK-4", "PRJ-13"), sql="""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
r AS (SELECT stage, vec_id, label, v FROM e JOIN (SELECT unnest([90, 300]) AS stage) st ON e.rn <= st.stage)
SELECT form, stage, vec_id, label, CAST(round(v[1], 6) AS DOUBLE) AS first_dim, CAST(round(v[64], 6) AS DOUBLE) AS last_dim,
       CAST(round(list_sum(list_transform(v, lambda x: x * x)), 6) AS DOUBLE) AS sq_norm, len(v)::INT AS dims
FROM r, (SELECT unnest(['arrays', 'wide']) AS form)""")
def q_vector_snapshots(spark, sf_dir):
    """Snapshots after 90 and 300 arrivals, from the array files and from the CSV."""
    from quarry.operators.indexing import dense_index
    from quarry.sources.vector_arrays import read_snapshots, write_snapshots
    e = dense_index(embeddings(spark, sf_dir), "vec_id", "_i")
    stages = spark.range(1).select(F.explode(F.array(F.lit(90), F.lit(300))).alias("stage"))
    path = _scratch(spark, "snapshots")
    write_snapshots(e.join(F.broadcast(stages), F.col("_i") < F.col("stage")), path, "embedding", 64)  # 2 literal stages
    arrays = read_snapshots(spark, path).select(F.lit("arrays").alias("form"), "stage", F.col("id").alias("vec_id"), "label", "vector")
    dims = [f"dim_{j}" for j in range(64)]
    schema = StructType.fromDDL("stage int, vec_id long, " + ", ".join(f"{d} double" for d in dims) + ", label int")
    wide = spark.read.schema(schema).option("header", True).csv(f"{path}/wide").select(
        F.lit("wide").alias("form"), "stage", "vec_id", "label", F.array(*dims).alias("vector"))
    sq = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rounded(arrays.unionByName(wide).select(
        "form", "stage", "vec_id", "label", F.element_at("vector", 1).alias("first_dim"), F.element_at("vector", -1).alias("last_dim"),
        sq.alias("sq_norm"), F.size("vector").alias("dims")))


@register("row_faults", operators=("FLT-14", "SRC-4"), sql="""
WITH k AS (SELECT lang, doc_id % 5 AS m FROM documents)
SELECT coalesce(reason, 'good') AS reason, count(*) AS n, count(DISTINCT lang) AS langs, true AS counted FROM (
  SELECT NULL AS reason, lang FROM k
  UNION ALL SELECT CASE m WHEN 0 THEN 'malformed' WHEN 1 THEN 'empty' WHEN 2 THEN 'not an object' WHEN 3 THEN 'missing field'
                   ELSE 'wrong type' END, NULL FROM k) x
GROUP BY 1""")
def q_row_faults(spark, sf_dir):
    """Every document as a whole line with a broken line beside it, of one of
    five kinds; one pass parses, sorts out and counts them.  ``counted``: the
    counts observed while writing equal those of the rows read back."""
    from quarry.sources.faults import parsed, split_faults
    d = table(spark, sf_dir, "documents")
    fields = ("doc_id", "text", "lang", "source", "n_chars")
    js = F.to_json(F.struct(*fields))
    m = F.col("doc_id") % 5
    broken = (F.when(m == 0, F.substr(js, F.lit(1), F.length(js) - 1)).when(m == 1, F.lit("  ")).when(m == 2, F.to_json(F.array("lang")))
              .when(m == 3, F.to_json(F.struct("text", "lang"))).otherwise(F.to_json(F.struct(F.lit("x").alias("doc_id"), "text", "lang"))))
    raw = _scratch(spark, "lines")
    d.select(F.explode(F.array(js, broken)).alias("value")).write.option("compression", "gzip").text(raw)
    rows = parsed(spark.read.text(raw), {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
                  ("doc_id", "text"))
    good, bad, counts = split_faults(rows, _scratch(spark, "faults"))
    out = good.select(F.lit("good").alias("reason"), "lang").unionByName(bad.select("reason", F.lit(None).cast("string").alias("lang")))
    seen = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    n = out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))
    return n.withColumn("counted", F.element_at(seen, F.col("reason")) == F.col("n"))


@register("metrics_document", operators=("SNK-5", "FLT-5", "AGG-1", "AGG-2"), sql=SCORED_CTE + """
, t AS (SELECT anomaly_score >= 0.3 AS fired, toxic FROM scored WHERE toxic IS NOT NULL),
m AS (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1 AND fired) AS tp, count(*) FILTER (WHERE toxic <> 1 AND fired) AS fp,
             count(*) FILTER (WHERE toxic = 1 AND NOT fired) AS fn FROM t)
SELECT n, tp, fp, fn, (SELECT count(*) FROM scored WHERE anomaly_score >= 0.3) AS triggered,
       CAST(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS DOUBLE) AS "precision",
       CAST(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS DOUBLE) AS recall
FROM m""")
def q_metrics_document(spark, sf_dir):
    """The trigger's metrics as one JSON document, written and read back, with
    the number of samples that pass the trigger filter."""
    from quarry.operators.buffer_ops import write_metrics
    from quarry.operators.metrics import binary_metrics
    from quarry.operators.trigger import keep_triggered
    s = materialize(scored_samples(spark, sf_dir).select("sample_id", "anomaly_score", "trigger", "toxic"))
    fired = keep_triggered(s).agg(F.count(F.lit(1)).alias("triggered"))
    doc = binary_metrics(s, "toxic", "trigger").select("n", "tp", "fp", "fn", "precision", "recall").crossJoin(fired)  # one row each
    path = _scratch(spark, "metrics-document")
    write_metrics(doc, path, "json")
    return rounded(spark.read.schema(doc.schema).json(path))


@register("metrics_csv", operators=("SNK-3", "AGG-23"), sql="""
SELECT toxic, count(*) AS n, (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)) AS min_count
FROM labels GROUP BY toxic""")
def q_metrics_csv(spark, sf_dir):
    """Class counts as a CSV with a header, read back by that header."""
    from quarry.operators.buffer_ops import write_metrics
    from quarry.operators.sampling import class_counts
    counts = class_counts(table(spark, sf_dir, "labels"), "toxic")
    path = _scratch(spark, "metrics-csv")
    write_metrics(counts, path, "csv")
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("toxic").cast(counts.schema["toxic"].dataType).alias("toxic"), F.col("n").cast("long").alias("n"),
                       F.col("min_count").cast("long").alias("min_count"))


@register("virtual_cluster", operators=("PRJ-18", "FN-28", "AGG-12"), sql="""
SELECT -1::BIGINT AS cluster_id, 'all_samples' AS cluster_label, 'anomaly_cluster_-1' AS anomaly_label, source,
       count(*) AS num_samples
FROM documents GROUP BY source""")
def q_virtual_cluster(spark, sf_dir):
    """All documents as one cluster, counted per source."""
    from quarry.functions.text import anomaly_label
    from quarry.operators.samples import as_virtual_cluster
    v = as_virtual_cluster(table(spark, sf_dir, "documents").select("source"))
    return (v.withColumn("anomaly_label", anomaly_label("cluster_id")).groupBy("cluster_id", "cluster_label", "anomaly_label", "source")
            .agg(F.count(F.lit(1)).alias("num_samples")))


@register("first_runs", operators=("SRT-2", "SRT-1"), sql="""
SELECT event_id, event_type, value AS val_acc, user_id AS val_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id, event_id) AS rank FROM events) t
WHERE rank <= 3 ORDER BY rank, event_type, event_id LIMIT 5""")
def q_first_runs(spark, sf_dir):
    """The first five of the per-type best runs, by rank."""
    from quarry.operators.sampling import first_runs, top_runs
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("val_acc"), F.col("user_id").alias("val_loss"))
    best = top_runs(ev, "event_type", 3, tie="event_id")
    return first_runs(best, ["rank", "event_type", "event_id"], 5).select("event_id", "event_type", "val_acc", "val_loss")


@register("cluster_rows", operators=("JOIN-2", "FLT-7", "FN-28", "AGG-9"), sql=BASE + """,
s AS (SELECT bucket, pred AS cluster_id, count(*) AS num_samples FROM mem GROUP BY bucket, pred HAVING count(*) >= 20)
SELECT mem.vec_id AS sample_id, s.bucket, s.cluster_id, s.bucket || '_cluster_' || CAST(s.cluster_id AS VARCHAR) AS cluster_label, s.num_samples
FROM mem JOIN s ON s.bucket = mem.bucket AND s.cluster_id = mem.pred""")
def q_cluster_rows(spark, sf_dir):
    """The rows of clusters of at least 20 samples, each with its cluster's
    summary row, joined by (bucket, cluster id)."""
    from quarry.functions.text import cluster_label
    from quarry.operators.buffer_ops import size_gate, with_cluster
    m = materialize(ncc_members(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), "bucket", F.col("pred").alias("cluster_id")))
    sizes = m.groupBy("bucket", "cluster_id").agg(F.count(F.lit(1)).alias("num_samples"))
    sizes = size_gate(sizes, 20).withColumn("cluster_label", cluster_label("bucket", "cluster_id"))
    return with_cluster(m, sizes).select("sample_id", "bucket", "cluster_id", "cluster_label", "num_samples")


@register("buffer_integrity", operators=("AGG-28", "JOIN-13"), sql=BASE + """,
ids AS (SELECT DISTINCT bucket, pred AS cid FROM mem),
vecs AS (SELECT bucket, cid FROM ids WHERE cid <> 1),
kw AS (SELECT bucket, cid FROM ids WHERE cid <> 2),
cl AS (SELECT bucket, cid FROM ids WHERE cid <> 0)
SELECT i.bucket, count(*) AS mapped, count(*) FILTER (WHERE cl.cid IS NULL) AS orphan_ids,
       (SELECT count(*) FROM cl c WHERE c.bucket = i.bucket) AS cluster_ids,
       (SELECT count(*) FROM vecs c WHERE c.bucket = i.bucket) AS centroids,
       (SELECT count(*) FROM kw c WHERE c.bucket = i.bucket) AS keyword_sets,
       count(*) FILTER (WHERE cl.cid IS NULL) = 0
       AND (SELECT count(*) FROM cl c WHERE c.bucket = i.bucket) = (SELECT count(*) FROM vecs c WHERE c.bucket = i.bucket)
       AND (SELECT count(*) FROM cl c WHERE c.bucket = i.bucket) = (SELECT count(*) FROM kw c WHERE c.bucket = i.bucket) AS sound
FROM ids i LEFT JOIN cl ON cl.bucket = i.bucket AND cl.cid = i.cid WHERE i.bucket IS NOT NULL GROUP BY i.bucket""")
def q_buffer_integrity(spark, sf_dir):
    """Ids, centroids and keyword sets of a buffer that lacks the cluster row
    0, the centroid of 1 and the keyword set of 2."""
    from quarry.operators.buffer_ops import buffer_integrity
    m = materialize(ncc_members(spark, sf_dir).where("bucket is not null").select("bucket", F.col("pred").alias("cluster_id")).distinct())
    return buffer_integrity(m, *(m.where(F.col("cluster_id") != k) for k in (0, 1, 2)))


@register("geometric_sweep", operators=("FN-26", "JOIN-9", "AGG-2"), sql=SCORED_CTE + """
, g AS (SELECT i, 0.01 * pow(100.0, i / 8.0) AS threshold FROM range(9) t(i))
SELECT i::INT AS step, CAST(round(threshold, 6) AS DOUBLE) AS threshold, count(*) FILTER (WHERE anomaly_score >= threshold) AS triggered
FROM scored, g GROUP BY i, threshold""")
def q_geometric_sweep(spark, sf_dir):
    """Samples above each of nine thresholds from 0.01 to 1, in equal ratios."""
    from quarry.operators.sweeps import geomspace
    grid = geomspace(0.01, 1.0, 9)
    counts = scored_samples(spark, sf_dir).agg(*[F.count_if(F.col("anomaly_score") >= t).alias(f"t{i}") for i, t in enumerate(grid)])
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold"), F.col(f"t{i}").alias("triggered")) for i, t in enumerate(grid)])
    return rounded(counts.select(F.inline(steps)))
