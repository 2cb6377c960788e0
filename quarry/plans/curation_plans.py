"""Remaining inventory items: run fingerprints and the processed-run skip,
warm-start gate, text composition, metric normalisation, attempt stability,
stream snapshots, multi-line JSON, text-only trigger, per-cluster caps."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import cluster_metrics as M
from quarry.operators import sampling as SM
from quarry.operators import samples as S
from quarry.operators.centroids import centroids
from quarry.operators.trigger import fit_band, score_anomaly
from quarry.plans import trigger_plans
from quarry.plans.registry import register, rounded
from quarry.session import checkpoint_dir
from quarry.sources import io as IO
from quarry.sources.tables import table
from quarry.streaming import stateful as ST
from quarry.streaming.runner import run_available_now, table_stream


@register("run_fingerprints", operators=("FN-25", "PRJ-17", "FLT-8", "JOIN-13"), sql="""
WITH runs AS (SELECT DISTINCT event_type, user_id FROM events),
done AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 90)
SELECT r.event_type, r.user_id,
  substr(md5('{"event_type":"' || r.event_type || '","user":"' || CAST(r.user_id AS VARCHAR) || '"}'),
         1, 8) AS fingerprint
FROM runs r ANTI JOIN done d ON d.event_type = r.event_type AND d.user_id = r.user_id""")
def q_run_fingerprints(spark, sf_dir):
    """Run configurations (event_type x user) as string maps; fingerprint;
    skip the runs already processed (left anti join on the processed table)."""
    ev = table(spark, sf_dir, "events")
    runs = ev.select("event_type", "user_id").distinct()
    done = ev.filter(F.col("value") > 90).select("event_type", "user_id").distinct()
    todo = runs.join(done, ["event_type", "user_id"], "left_anti")
    cfg = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event_type"),
                       F.col("event_type"))
    cfg = F.transform_values(cfg, lambda k, v: v.cast("string"))  # PRJ-17
    return todo.select("event_type", "user_id", T.fingerprint(cfg).alias("fingerprint"))


@register("warm_start_gate", operators=("FLT-10", "SET-3"), sql="""
SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_texts,
       count(*) >= 10 AND count(DISTINCT text) >= 40 AS ready
FROM documents GROUP BY source""")
def q_warm_start_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                F.countDistinct(F.unhex(F.sha2("text", 256))).alias("distinct_texts"))
    return g.withColumn("ready", (F.col("n") >= 10) & (F.col("distinct_texts") >= 2 * 20))


@register("holdout_texts", operators=("PRJ-7", "PRJ-6", "FN-24", "FN-27", "WIN-9"), sql="""
WITH d AS (
  SELECT doc_id, source, text, CAST(n_chars AS VARCHAR) AS real_answer,
    row_number() OVER (PARTITION BY source ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn,
    count(*) OVER (PARTITION BY source) AS n
  FROM documents),
s AS (SELECT *, CASE WHEN rn > n - greatest(floor(n * 0.2), 1) THEN 'val' ELSE 'train' END AS split,
             '[Question]' || chr(10) || text AS q, '[Answer]' || chr(10) || text AS p FROM d)
SELECT doc_id, split,
  md5(CASE WHEN split = 'train'
           THEN q || chr(10) || 'Prompt' || p || chr(10) || 'Answer:' || chr(10) || ' ' || real_answer
           ELSE q || chr(10) || p || chr(10) || 'Answer:' || chr(10) END) AS model_text_md5,
  md5(q || ' ' || p) AS composite_md5,
  CAST(length(substring(text, 1, 512)) AS INTEGER) AS truncated_len,
  'Question: ' || source || chr(10) || 'Answer:' AS numeric_prompt,
  ' #### ' || real_answer AS numeric_completion,
  CAST(real_answer AS INTEGER) AS numeric_label
FROM s""")
def q_holdout_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    x = d.select("doc_id", "source", F.col("text").alias("doc_text"),
                 F.col("n_chars").cast("string").alias("real_answer"),
                 F.concat(F.lit("[Question]\n"), "text").alias("text"),
                 F.concat(F.lit("[Answer]\n"), "text").alias("full_prompt"))
    h = S.train_val_text(SM.holdout(x, "source", "doc_id", seed=42, ratio=0.2), "split")
    gold = T.gold_number(F.concat(F.lit(" #### "), F.col("real_answer")))
    return h.select(
        "doc_id", "split", F.md5("model_text").alias("model_text_md5"),
        F.md5(T.composite_text("text", "full_prompt")).alias("composite_md5"),
        F.length(T.truncate("doc_text", 512)).alias("truncated_len"),
        F.concat(F.lit("Question: "), "source", F.lit("\nAnswer:")).alias("numeric_prompt"),
        F.concat(F.lit(" #### "), "real_answer").alias("numeric_completion"),
        gold.alias("numeric_label"))


@register("metric_normalise", operators=("WIN-14", "AGG-29"), sql="""
WITH m AS (
  SELECT event_type AS method, 'mean_value' AS metric, avg(value) AS value FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'max_value', max(value) FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM events GROUP BY 1),
n AS (
  SELECT method, metric, value,
    coalesce((value - min(value) OVER (PARTITION BY metric))
             / (max(value) OVER (PARTITION BY metric) - min(value) OVER (PARTITION BY metric) + 1e-8),
             0.0) AS normalised,
    count(DISTINCT method) OVER (PARTITION BY metric) = (SELECT count(DISTINCT method) FROM m)
      AS consistent
  FROM m)
SELECT method, metric, CAST(round(value, 6) AS DOUBLE) AS value,
       CAST(round(normalised, 6) AS DOUBLE) AS normalised, consistent FROM n""")
def q_metric_normalise(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    per = ev.groupBy(F.col("event_type").alias("method")).agg(
        F.avg("value").alias("mean_value"), F.max("value").alias("max_value"),
        F.countDistinct("user_id").cast("double").alias("users"))
    long = per.select("method", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("mean_value", "max_value", "users")])).alias("x")).select("method", "x.*")
    norm = M.normalise_metrics(long, "metric", "value")
    cons = M.metric_consistency(long, "method", "metric").select("metric", "consistent")
    return rounded(norm.join(cons, "metric").select("method", "metric", "value", "normalised",
                                                    "consistent"))


ATTEMPTS = 3


def _attempt_centres(spark, sf_dir):
    """Attempts = growing prefixes of each language bucket in vec_id order (a
    third, two thirds, all of it); labels = nearest label centroid."""
    from quarry.plans.cluster_plans import ncc_members
    m = ncc_members(spark, sf_dir)
    r = SM.group_rank(m, "bucket", ["vec_id"], "pos", count_out="cnt")
    first = F.ceil(F.col("pos") * ATTEMPTS / F.col("cnt")).cast("int") - 1  # the first attempt to hold the row
    return r.withColumn("attempt", F.explode(F.sequence(first, F.lit(ATTEMPTS - 1)))).drop("cnt")


def _attempt_sql() -> str:
    from quarry.plans.cluster_plans import BASE, _agreement_sql_by, _cos
    return BASE + """,
r AS (SELECT bucket, pred, v, row_number() OVER (PARTITION BY bucket ORDER BY vec_id) AS pos,
             count(*) OVER (PARTITION BY bucket) AS cnt FROM mem),
att AS (SELECT unnest([0, 1, 2]) AS attempt),
rws AS (SELECT r.*, CAST(att.attempt AS INTEGER) AS attempt FROM r
        JOIN att ON r.pos * 3 <= r.cnt * (att.attempt + 1)),
al AS (SELECT c.bucket || ':' || CAST(c.attempt AS VARCHAR) AS ga, p.pred AS prev, c.pred AS cur
       FROM rws c JOIN rws p ON p.bucket = c.bucket AND p.attempt = c.attempt - 1
                            AND p.pos = c.pos),""" + _agreement_sql_by("al", "prev", "cur", "ga") + """,
acen0 AS (
  SELECT bucket, attempt, pred, min(first) AS first, list(m ORDER BY dim) AS c FROM (
    SELECT bucket, attempt, pred, dim, avg(x) AS m, min(pos) AS first FROM (
      SELECT bucket, attempt, pred, pos, unnest(v) AS x, generate_subscripts(v, 1) AS dim
      FROM rws) t GROUP BY bucket, attempt, pred, dim) u
  GROUP BY bucket, attempt, pred),
acen AS (SELECT *, row_number() OVER (PARTITION BY bucket, attempt ORDER BY first) AS ord,
               count(*) OVER (PARTITION BY bucket, attempt) AS k FROM acen0),
sim AS (SELECT c1.bucket, c1.attempt, avg(""" + _cos("c1.c", "c0.c") + """) AS center_sim
        FROM acen c1 JOIN acen c0 ON c0.bucket = c1.bucket AND c0.attempt = c1.attempt - 1
                              AND c0.ord = c1.ord AND c0.k = c1.k
        GROUP BY c1.bucket, c1.attempt),
ks AS (SELECT DISTINCT bucket, attempt, k FROM acen),
res AS (
  SELECT ks.bucket, ks.attempt, ks.k, coalesce(gag.ari, 0.0) AS ari,
         coalesce(sim.center_sim, 0.0) AS center_sim
  FROM ks LEFT JOIN gag ON gag.g = ks.bucket || ':' || CAST(ks.attempt AS VARCHAR)
  LEFT JOIN sim ON sim.bucket = ks.bucket AND sim.attempt = ks.attempt)
SELECT bucket, attempt, k, CAST(round(ari, 6) AS DOUBLE) AS ari,
       CAST(round(center_sim, 6) AS DOUBLE) AS center_sim,
       ari >= 0.8 AND center_sim >= 0.5 AS stable
FROM res"""


@register("attempt_stability", operators=("CLU-4", "JOIN-7", "JOIN-8", "AGG-14"),
          sql=_attempt_sql())
def q_attempt_stability(spark, sf_dir):
    """CLU-4: attempt a vs a-1 per bucket: ARI over the common prefix
    (JOIN-8, rows joined on position), mean cosine of centres zipped by order
    of first appearance (JOIN-7, only when the counts match); stable when
    ARI >= 0.8 and centre similarity >= 0.5; the first attempt never is."""
    from quarry.functions.vectors import cosine
    rows = _attempt_centres(spark, sf_dir)
    cur = rows.select("bucket", "attempt", "pos", F.col("pred").alias("cur"))
    prev = rows.select("bucket", (F.col("attempt") + 1).alias("attempt"), "pos",
                       F.col("pred").alias("prev"))
    aligned = cur.join(prev, ["bucket", "attempt", "pos"], "inner")   # JOIN-8 prefix
    ag = M.agreement(aligned, "prev", "cur", by=["bucket", "attempt"]).select(
        "bucket", "attempt", "ari")
    first = rows.groupBy("bucket", "attempt", "pred").agg(F.min("pos").alias("_first"))
    cen = centroids(rows, ["bucket", "attempt", "pred"]).join(first, ["bucket", "attempt", "pred"])
    cen = cen.withColumn("ord", F.row_number().over(
        Window.partitionBy("bucket", "attempt").orderBy("_first")))  # per-attempt clusters
    k = cen.groupBy("bucket", "attempt").agg(F.count(F.lit(1)).alias("k"))
    c1 = cen.select("bucket", "attempt", "ord", F.col("centroid").alias("c1"))
    c0 = cen.select("bucket", (F.col("attempt") + 1).alias("attempt"), "ord",
                    F.col("centroid").alias("c0"))
    k0 = k.select("bucket", (F.col("attempt") + 1).alias("attempt"), F.col("k").alias("k0"))
    zipped = (c1.join(c0, ["bucket", "attempt", "ord"]).join(k, ["bucket", "attempt"])
              .join(k0, ["bucket", "attempt"]).filter(F.col("k") == F.col("k0")))  # JOIN-7
    sim = zipped.groupBy("bucket", "attempt").agg(F.avg(cosine("c1", "c0")).alias("center_sim"))
    out = (k.join(ag, ["bucket", "attempt"], "left").join(sim, ["bucket", "attempt"], "left")
           .select("bucket", "attempt", "k", F.coalesce("ari", F.lit(0.0)).alias("ari"),
                   F.coalesce("center_sim", F.lit(0.0)).alias("center_sim")))
    return rounded(out.withColumn("stable", (F.col("ari") >= 0.8) & (F.col("center_sim") >= 0.5)))


@register("stream_snapshots", operators=("STR-8", "JOIN-14", "STR-7"), sql="""
WITH p AS (SELECT event_id, event_type,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position
           FROM events),
st AS (SELECT unnest([90, 300, 1500]) AS stage)
SELECT stage, event_type, count(*) AS n FROM p JOIN st ON p.position < st.stage
GROUP BY stage, event_type""")
def q_stream_snapshots(spark, sf_dir):
    """Snapshots of the stream at fixed arrival counts (90 / 300 / 1500) per
    key, joined from the count-window sink."""
    s = table_stream(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    sink = run_available_now(ST.stream_count_windows(s, "event_type", ["ts", "event_id"],
                                                     "event_id", 200), name="stream-snap")
    stages = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (90, 300, 1500)]))
                                   .alias("stage"))
    snap = sink.join(F.broadcast(stages), F.col("position") < F.col("stage"))  # 3 literal stages
    return snap.groupBy("stage", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _array_files(it):
    """One JSON array per partition, over however many batches it comes in."""
    lead = "["
    for pdf in it:
        if len(pdf):
            yield pd.DataFrame({"value": [lead + ",\n".join(pdf["j"].tolist())]})
            lead = ","
    if lead == ",":
        yield pd.DataFrame({"value": ["]"]})


@register("multiline_json", operators=("SRC-2",), sql="""
SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang""")
def q_multiline_json(spark, sf_dir):
    """Each partition written as one JSON array document (pretty, several
    lines), read back with ``multiLine`` and an explicit schema."""
    from quarry.plans.io_plans import DOC_SCHEMA
    d = table(spark, sf_dir, "documents")
    js = d.select(F.to_json(F.struct(*[c.name for c in DOC_SCHEMA.fields])).alias("j"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/jsonarray-{uuid.uuid4().hex}"
    js.mapInPandas(_array_files, "value string").write.text(path)
    back = IO.read_samples(spark, path, "json-array", DOC_SCHEMA)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("text_only_trigger", operators=("FN-29", "FN-9"), sql="WITH " + trigger_plans._COMPONENTS_SQL
          + """,
eff AS (SELECT comp.*, CASE WHEN bucket LIKE '%1%' THEN 1.0 ELSE similarity END AS es FROM comp)
SELECT sample_id,
  CAST(round((0.33 * (1 - margin / 0.25) + 0.12 * (1 - 1.0) + 0.23 * (1 - 1.0) + 0.33 * (1 - es))
       * CASE WHEN es > band_lo AND es < band_hi THEN 0.5 ELSE 1.0 END, 6) AS DOUBLE) AS anomaly_score,
  (0.33 * (1 - margin / 0.25) + 0.12 * (1 - 1.0) + 0.23 * (1 - 1.0) + 0.33 * (1 - es))
       * CASE WHEN es > band_lo AND es < band_hi THEN 0.5 ELSE 1.0 END >= 0.3 AS "trigger"
FROM eff, band""")
def q_text_only_trigger(spark, sf_dir):
    """FN-29: rows without a gold answer (here: sources with a '1' in the
    name) score with bleu = rouge = similarity = 1; the band is still taken
    from the measured similarity of the ID rows."""
    comp = trigger_plans.sample_components(spark, sf_dir)
    band = fit_band(comp, "similarity", where=F.col("quality") == 1)
    comp = comp.withColumn("gold", F.when(F.col("bucket").contains("1"), F.lit(None))
                           .otherwise(F.lit("gold text")))
    s = score_anomaly(comp, band, weights=trigger_plans.SLICE_WEIGHTS,
                      max_margin=trigger_plans.SLICE_MAX_MARGIN,
                      threshold=trigger_plans.SLICE_THRESHOLD, gold="gold")
    return rounded(s.select("sample_id", "anomaly_score", "trigger"))


@register("cap_per_cluster", operators=("WIN-4", "SRT-4"), sql="""
SELECT vec_id, label FROM (
  SELECT vec_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR))) AS rn
  FROM embeddings) t WHERE rn <= 40""")
def q_cap_per_cluster(spark, sf_dir):
    """WIN-4: a seeded sample of at most 40 rows per cluster (label)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = SM.capped_rank(e.withColumn("_h", SM.hash_order("vec_id", 42)), "label", ["_h"], 40)
    return r.select("vec_id", "label")

