"""M6: cluster analytics over ``embeddings`` (+ ``documents`` for buckets,
sources and keywords).

Truth = ``embeddings.label``; predicted cluster = the nearest label centroid
by cosine (ties -> smallest label); bucket = ``documents.lang``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import keywords
from quarry.functions.vectors import cosine
from quarry.operators import centroids as C
from quarry.operators import cluster_metrics as M
from quarry.operators.quantiles import exact_quantiles
from quarry.plans.registry import register, rounded
from quarry.sources.tables import embeddings, table

def ncc_members(spark, sf_dir):
    """Members table: vec_id, embedding, label (truth), pred (nearest label
    centroid), bucket (lang), source."""
    e = embeddings(spark, sf_dir)
    cents = C.centroids(e, "label").withColumnRenamed("label", "cluster_id")
    a = C.assign_to_centroids(e, cents, "embedding", "cluster_id", "centroid", "cosine", "pred")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"),
                                                 F.col("lang").alias("bucket"), "source", "text")
    return a.join(d, "vec_id", "inner")


_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_CEN = """cen AS (
  SELECT label, list(m ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) t
    GROUP BY label, pos) u
  GROUP BY label)"""


def _cos(a: str, b: str) -> str:
    return (f"(CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) > 0 "
            f"THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) "
            f"* sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END)")


_NCC = f"""ncc AS (
  SELECT vec_id, label, v, pred FROM (
    SELECT e.vec_id, e.label, e.v, cen.label AS pred,
           row_number() OVER (PARTITION BY e.vec_id ORDER BY {_cos('e.v', 'cen.c')} DESC,
                                                             cen.label) AS rk
    FROM e, cen) t WHERE rk = 1),
mem AS (
  SELECT ncc.*, d.lang AS bucket, d.source, d.text
  FROM ncc JOIN documents d ON d.doc_id = ncc.vec_id)"""

BASE = f"WITH {_E},\n{_CEN},\n{_NCC}"


@register("centroids", operators=("AGG-9", "PRJ-14"), sql=f"""
WITH {_E}, {_CEN}
SELECT label, CAST(pos - 1 AS BIGINT) AS dim, CAST(round(x, 6) AS DOUBLE) AS value
FROM (SELECT label, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM cen) t""")
def q_centroids(spark, sf_dir):
    c = C.centroids(embeddings(spark, sf_dir), "label")
    return rounded(c.select("label", F.posexplode("centroid").alias("dim", "value"))
                   .withColumn("dim", F.col("dim").cast("long")))


@register("intra_distance", operators=("AGG-10", "FLT-11"), sql=f"""
WITH {_E}, {_CEN}
SELECT e.label, CAST(round(avg(1 - {_cos('e.v', 'cen.c')}), 6) AS DOUBLE) AS intra_distance,
       count(*) AS n
FROM e JOIN cen ON cen.label = e.label
WHERE e.label IN (SELECT label FROM e GROUP BY label HAVING count(*) >= 2)
GROUP BY e.label""")
def q_intra_distance(spark, sf_dir):
    return rounded(C.intra_distance(embeddings(spark, sf_dir), "label"))


@register("inter_distance", operators=("AGG-11", "JOIN-4"), sql=f"""
WITH {_E}, {_CEN},
p AS (SELECT 1 - {_cos('a.c', 'b.c')} AS d FROM cen a JOIN cen b ON a.label < b.label)
SELECT count(*) AS n_pairs, CAST(round(avg(d), 6) AS DOUBLE) AS mean_distance,
       CAST(round(stddev_pop(d), 6) AS DOUBLE) AS std_distance FROM p""")
def q_inter_distance(spark, sf_dir):
    c = C.centroids(embeddings(spark, sf_dir), "label")
    return rounded(C.pairwise_cosine_stats(c, "centroid"))


def _agreement_sql(src: str, t: str, p: str) -> str:
    return f"""
cont AS (SELECT {t} AS t, {p} AS p, CAST(count(*) AS DOUBLE) AS c FROM {src} GROUP BY 1, 2),
cells AS (SELECT sum(c) AS n, sum(c * c) AS ss, sum(c * ln(c)) AS s_cell FROM cont),
rw AS (SELECT sum(a * a) AS sa2, sum(a * ln(a)) AS s_true, count(*) AS k_true
       FROM (SELECT t, sum(c) AS a FROM cont GROUP BY t) x),
cl AS (SELECT sum(b * b) AS sb2, sum(b * ln(b)) AS s_pred, count(*) AS k_pred
       FROM (SELECT p, sum(c) AS b FROM cont GROUP BY p) x),
z AS (SELECT n, ss - n AS tp, sb2 - ss AS fp, sa2 - ss AS fn, n * n - (sb2 - ss) - (sa2 - ss) - ss AS tn,
             ln(n) + (s_cell - s_true - s_pred) / n AS mi_raw, ln(n) - s_true / n AS ht,
             ln(n) - s_pred / n AS hp, k_true, k_pred
      FROM cells, rw, cl),
zz AS (SELECT *, CASE WHEN abs(mi_raw) < 1e-15 THEN 0.0 ELSE greatest(mi_raw, 0.0) END AS mi FROM z),
ag AS (
  SELECT CAST(n AS BIGINT) AS n,
    CASE WHEN fn = 0 AND fp = 0 THEN 1.0
         ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari,
    CASE WHEN k_true = 1 AND k_pred = 1 THEN 1.0 WHEN mi = 0 THEN 0.0
         ELSE mi / ((ht + hp) / 2) END AS nmi,
    CASE WHEN ht > 0 THEN mi / ht ELSE 1.0 END AS homogeneity,
    CASE WHEN hp > 0 THEN mi / hp ELSE 1.0 END AS completeness
  FROM zz)"""


def _agreement_sql_by(src: str, t: str, p: str, g: str) -> str:
    """``_agreement_sql`` per group ``g`` (a quoted column name)."""
    return f"""
gcont AS (SELECT {g} AS g, {t} AS t, {p} AS p, CAST(count(*) AS DOUBLE) AS c
          FROM {src} GROUP BY 1, 2, 3),
gcells AS (SELECT g, sum(c) AS n, sum(c * c) AS ss, sum(c * ln(c)) AS s_cell FROM gcont GROUP BY g),
grw AS (SELECT g, sum(a * a) AS sa2, sum(a * ln(a)) AS s_true, count(*) AS k_true
        FROM (SELECT g, t, sum(c) AS a FROM gcont GROUP BY g, t) x GROUP BY g),
gcl AS (SELECT g, sum(b * b) AS sb2, sum(b * ln(b)) AS s_pred, count(*) AS k_pred
        FROM (SELECT g, p, sum(c) AS b FROM gcont GROUP BY g, p) x GROUP BY g),
gz AS (SELECT gcells.g, n, ss - n AS tp, sb2 - ss AS fp, sa2 - ss AS fn,
              n * n - (sb2 - ss) - (sa2 - ss) - ss AS tn,
              ln(n) + (s_cell - s_true - s_pred) / n AS mi_raw, ln(n) - s_true / n AS ht,
              ln(n) - s_pred / n AS hp, k_true, k_pred
       FROM gcells JOIN grw ON grw.g = gcells.g JOIN gcl ON gcl.g = gcells.g),
gzz AS (SELECT *, CASE WHEN abs(mi_raw) < 1e-15 THEN 0.0 ELSE greatest(mi_raw, 0.0) END AS mi
        FROM gz),
gag AS (
  SELECT g, CAST(n AS BIGINT) AS n,
    CASE WHEN fn = 0 AND fp = 0 THEN 1.0
         ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari,
    CASE WHEN k_true = 1 AND k_pred = 1 THEN 1.0 WHEN mi = 0 THEN 0.0
         ELSE mi / ((ht + hp) / 2) END AS nmi,
    CASE WHEN ht > 0 THEN mi / ht ELSE 1.0 END AS homogeneity,
    CASE WHEN hp > 0 THEN mi / hp ELSE 1.0 END AS completeness
  FROM gzz)"""


@register("cluster_agreement", operators=("AGG-14", "AGG-15", "AGG-16", "JOIN-1"),
          sql=BASE + "," + _agreement_sql("mem", "label", "pred") + """
SELECT n, CAST(round(ari, 6) AS DOUBLE) AS ari, CAST(round(nmi, 6) AS DOUBLE) AS nmi,
  CAST(round(homogeneity, 6) AS DOUBLE) AS homogeneity,
  CAST(round(completeness, 6) AS DOUBLE) AS completeness,
  CAST(round(CASE WHEN homogeneity + completeness > 0
             THEN 2 * homogeneity * completeness / (homogeneity + completeness) ELSE 0.0 END, 6)
       AS DOUBLE) AS v_measure
FROM ag""")
def q_cluster_agreement(spark, sf_dir):
    m = ncc_members(spark, sf_dir)
    return rounded(M.agreement(m, "label", "pred"))


@register("silhouette", operators=("AGG-17",), sql=f"""
WITH {_E},
d AS (SELECT a.vec_id, a.label AS own, b.label AS other,
             sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))
               AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, own, other, avg(dist) AS md FROM d GROUP BY ALL),
s AS (SELECT vec_id,
        max(md) FILTER (WHERE other = own) AS a,
        min(md) FILTER (WHERE other <> own) AS b
      FROM m GROUP BY vec_id),
k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM e)
SELECT CASE WHEN k > 1 AND k < n THEN CAST(round(avg(CASE WHEN a IS NULL THEN 0.0
                                       ELSE (b - a) / greatest(a, b) END), 6) AS DOUBLE) END
         AS silhouette,
       (SELECT count(*) FROM e) AS n
FROM s, k GROUP BY k, n""")
def q_silhouette(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(M.silhouette(e, "vec_id", "label", "embedding"))


@register("silhouette_fast", operators=("AGG-17",), sql=f"""
WITH {_E},
d AS (SELECT a.vec_id, a.label AS own, b.label AS other,
             list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
               AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, own, other, avg(dist) AS md FROM d GROUP BY ALL),
s AS (SELECT vec_id, max(md) FILTER (WHERE other = own) AS a,
             min(md) FILTER (WHERE other <> own) AS b FROM m GROUP BY vec_id)
SELECT CAST(round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS DOUBLE)
         AS "silhouette_squaredEuclidean"
FROM s""")
def q_silhouette_fast(spark, sf_dir):
    """Linear-time squared-Euclidean silhouette (ClusteringEvaluator)."""
    return rounded(M.silhouette_squared(embeddings(spark, sf_dir), "label", "embedding"))


@register("central_sim", operators=("AGG-19",), sql=f"""
WITH {_E}, {_CEN}
SELECT CAST(round(avg({_cos('e.v', 'cen.c')}), 6) AS DOUBLE) AS central_similarity
FROM e JOIN cen ON cen.label = e.label""")
def q_central_sim(spark, sf_dir):
    return rounded(C.central_similarity(embeddings(spark, sf_dir), "label"))


@register("cluster_summary", operators=("AGG-12", "SNK-8", "FN-28"),
          sql=BASE + """
SELECT bucket, pred AS cluster_id, bucket || '_cluster_' || CAST(pred AS VARCHAR) AS cluster_label,
       count(*) AS num_samples, count(*) >= 20 AS eligible
FROM mem GROUP BY bucket, pred""")
def q_cluster_summary(spark, sf_dir):
    from quarry.functions.text import cluster_label
    m = ncc_members(spark, sf_dir)
    s = m.groupBy("bucket", F.col("pred").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("num_samples"))
    return s.select("bucket", "cluster_id", cluster_label("bucket", "cluster_id").alias("cluster_label"),
                    "num_samples", (F.col("num_samples") >= 20).alias("eligible"))


@register("bucket_summary", operators=("AGG-12", "AGG-20"), sql=BASE + """
SELECT bucket, count(*) AS num_clusters, sum(c) AS num_samples,
       CAST(round(stddev_pop(c), 6) AS DOUBLE) AS size_std
FROM (SELECT bucket, pred, count(*) AS c FROM mem GROUP BY bucket, pred) t GROUP BY bucket""")
def q_bucket_summary(spark, sf_dir):
    m = ncc_members(spark, sf_dir)
    return rounded(M.cluster_sizes(m, "pred", by="bucket").withColumn(
        "num_samples", F.col("num_samples").cast("long")))


@register("source_mix", operators=("AGG-13",), sql=BASE + """
, c AS (SELECT pred, source, count(*) AS n FROM mem GROUP BY pred, source)
SELECT pred, sum(n) AS num_samples, count(*) AS num_sources, count(*) = 1 AS homogeneous,
       arg_min(source, (-n, source)) AS majority_source,
       CAST(round(max(n) / sum(n), 6) AS DOUBLE) AS majority_share
FROM c GROUP BY pred""")
def q_source_mix(spark, sf_dir):
    m = ncc_members(spark, sf_dir)
    return rounded(M.source_mix(m, "pred", "source").withColumn(
        "num_samples", F.col("num_samples").cast("long")))


def _kw_sql(t: str) -> str:
    from quarry.plans.text_plans import STOP_SQL as stop
    return (f"list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), "
            f"lambda w: length(w) > 3 AND regexp_full_match(w, '\\p{{L}}+') "
            f"AND NOT list_contains({stop}, w)))")


@register("keyword_union", operators=("AGG-22", "FN-4", "SET-4"), sql=BASE + """
SELECT DISTINCT bucket, pred AS cluster_id, word
FROM (SELECT bucket, pred, unnest(""" + _kw_sql("text") + """) AS word FROM mem) t""")
def q_keyword_union(spark, sf_dir):
    """AGG-22: distinct keywords per (bucket, cluster), as a long table."""
    m = ncc_members(spark, sf_dir)
    return (m.select("bucket", F.col("pred").alias("cluster_id"),
                     F.explode(keywords("text")).alias("word"))
            .distinct())


@register("assign_nearest", operators=("JOIN-3", "FN-20", "FN-21", "AGG-22", "STR-4"),
          sql=BASE + """,
kwd AS (SELECT vec_id, bucket, label, unnest(""" + _kw_sql("text") + """) AS word FROM mem),
cw AS (SELECT DISTINCT bucket, label AS cid, word FROM kwd),
cs AS (SELECT bucket, cid, count(*) AS ck FROM cw GROUP BY bucket, cid),
cc AS (
  SELECT bucket, label AS cid, list(m ORDER BY pos) AS c FROM (
    SELECT bucket, label, pos, avg(x) AS m FROM (
      SELECT bucket, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM mem) t
    GROUP BY bucket, label, pos) u
  GROUP BY bucket, label),
hit AS (SELECT k.vec_id, k.bucket, cw.cid, count(*) AS hit
        FROM (SELECT DISTINCT vec_id, bucket, word FROM kwd) k
        JOIN cw ON cw.bucket = k.bucket AND cw.word = k.word GROUP BY k.vec_id, k.bucket, cw.cid),
cand AS (
  SELECT m.vec_id, m.bucket, cc.cid,
         0.7 * """ + _cos("m.v", "cc.c") + """
         + 0.3 * coalesce(hit.hit, 0) / greatest(coalesce(cs.ck, 0), 1) AS score
  FROM mem m JOIN cc ON cc.bucket = m.bucket
  LEFT JOIN cs ON cs.bucket = cc.bucket AND cs.cid = cc.cid
  LEFT JOIN hit ON hit.vec_id = m.vec_id AND hit.bucket = m.bucket AND hit.cid = cc.cid)
SELECT m.vec_id AS sample_id, m.bucket, arg_max(cid, (score, -cid))::BIGINT AS assigned_cluster,
       CAST(round(max(score), 6) AS DOUBLE) AS match_score
FROM mem m LEFT JOIN cand ON cand.vec_id = m.vec_id GROUP BY m.vec_id, m.bucket""")
def q_assign_nearest(spark, sf_dir):
    """Every sample against the (bucket, label) clusters of its bucket."""
    m = ncc_members(spark, sf_dir)
    cl = C.centroids(m, ["bucket", "label"]).withColumnRenamed("label", "cluster_id")
    words = (m.select("bucket", F.col("label").alias("cluster_id"),
                      F.explode(keywords("text")).alias("word")).distinct())
    s = m.select(F.col("vec_id").alias("sample_id"), "bucket", "embedding",
                 keywords("text").alias("keywords"))
    return rounded(C.assign_nearest(s, cl, by="bucket", cluster_words=words))


@register("flat_tags", operators=("FN-30",), sql=BASE + """
SELECT vec_id, bucket || '_' || CAST(pred AS VARCHAR) AS tag FROM mem""")
def q_flat_tags(spark, sf_dir):
    m = ncc_members(spark, sf_dir)
    return m.select("vec_id", F.concat("bucket", F.lit("_"), F.col("pred").cast("string")).alias("tag"))


@register("macro_f1_sources", operators=("AGG-18",), sql=BASE + """,
c AS (SELECT pred, source, count(*) AS n FROM mem GROUP BY pred, source),
maj AS (SELECT pred, arg_min(source, (-n, source)) AS ms FROM c GROUP BY pred),
x AS (SELECT mem.source AS t, maj.ms AS p FROM mem JOIN maj ON maj.pred = mem.pred),
cont AS (SELECT t, p, count(*) AS c FROM x GROUP BY t, p),
cls AS (SELECT t AS cls FROM cont UNION SELECT p FROM cont),
per AS (
  SELECT cls.cls,
    coalesce((SELECT sum(c) FROM cont WHERE t = cls.cls), 0) AS support,
    coalesce((SELECT sum(c) FROM cont WHERE p = cls.cls), 0) AS predicted,
    coalesce((SELECT sum(c) FROM cont WHERE t = cls.cls AND p = cls.cls), 0) AS tp
  FROM cls),
pr AS (SELECT cls, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pp,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rr FROM per),
f AS (SELECT *, CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END AS f1 FROM pr)
SELECT CAST(round(avg(f1), 6) AS DOUBLE) AS macro_f1, CAST(sum(support) AS BIGINT) AS n FROM f""")
def q_macro_f1_sources(spark, sf_dir):
    return rounded(M.macro_f1_by_majority(ncc_members(spark, sf_dir), "pred", "source"))


def _window_cents(spark, sf_dir, size=200):
    from quarry.operators.buffer_ops import count_windows
    w = count_windows(embeddings(spark, sf_dir), "vec_id", size)
    return C.centroids(w, ["window", "label"]).withColumnRenamed("label", "cluster_id")


@register("window_drift", operators=("WIN-10", "WIN-12", "JOIN-6", "AGG-21"), sql=f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
                  CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 200) AS BIGINT) AS win
           FROM embeddings),
wc AS (
  SELECT win, label, list(m ORDER BY pos) AS c FROM (
    SELECT win, label, pos, avg(x) AS m FROM (
      SELECT win, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) t
    GROUP BY win, label, pos) u
  GROUP BY win, label),
b AS (SELECT cur.win, cur.label, max({_cos('cur.c', 'prev.c')}) AS best
      FROM wc cur JOIN wc prev ON prev.win = cur.win - 1 GROUP BY cur.win, cur.label)
SELECT win, CAST(round(avg(best), 6) AS DOUBLE) AS mean_center_sim,
       CAST(round(stddev_pop(best), 6) AS DOUBLE) AS std_center_sim
FROM b GROUP BY win""")
def q_window_drift(spark, sf_dir):
    wc = _window_cents(spark, sf_dir).withColumnRenamed("window", "win")
    prev = wc.withColumn("win", F.col("win") + 1)
    return rounded(C.best_match_similarity(wc, prev, "centroid", by="win"))


@register("auto_threshold", operators=("AGG-8", "JOIN-12"), sql="""
WITH e AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS i,
                  CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
tot AS (SELECT n * (n - 1) // 2 AS pairs, least(1000, n * (n - 1) // 2) AS m FROM n),
st AS (SELECT k, k * (pairs // m) + least(k, pairs % m) AS lo,
              (k + 1) * (pairs // m) + least(k + 1, pairs % m) AS hi
       FROM range(0, 1000) t(k), tot WHERE k < m),
dr AS (SELECT lo + CAST('0x' || substr(md5('42:' || CAST(k AS VARCHAR)), 1, 15) AS BIGINT) % (hi - lo) AS num FROM st),
p AS (SELECT num - e.i * (e.i - 1) // 2 AS i, e.i AS j FROM dr JOIN e
      ON num >= e.i * (e.i - 1) // 2 AND num < e.i * (e.i + 1) // 2),
c AS (SELECT CASE WHEN sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) > 0
                  THEN list_dot_product(a.v, b.v)
                       / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))
                  ELSE 0.0 END AS cos
      FROM p JOIN e a ON a.i = p.i JOIN e b ON b.i = p.j)
SELECT count(*) AS n_pairs,
       CAST(round(CASE WHEN count(*) >= 2 THEN quantile_cont(cos, 0.3) ELSE 0.45 END, 6) AS DOUBLE)
         AS similarity_threshold
FROM c""")
def q_auto_threshold(spark, sf_dir):
    from quarry.operators.buffer_ops import auto_threshold
    return rounded(auto_threshold(embeddings(spark, sf_dir), "vec_id", "embedding"))


@register("cluster_integrity", operators=("AGG-28", "JOIN-13"), sql=BASE + """
, cl AS (SELECT DISTINCT bucket, pred AS cluster_id FROM mem WHERE pred <> 0)
SELECT m.bucket, count(*) AS members,
       count(*) FILTER (WHERE cl.cluster_id IS NULL) AS orphan_members,
       count(DISTINCT m.pred) FILTER (WHERE cl.cluster_id IS NOT NULL) AS clusters
FROM mem m LEFT JOIN cl ON cl.bucket = m.bucket AND cl.cluster_id = m.pred
GROUP BY m.bucket""")
def q_cluster_integrity(spark, sf_dir):
    """Members against a cluster table missing cluster 0 (a deleted cluster):
    orphan counts per bucket (anti-join) and the live cluster count."""
    from quarry.operators.buffer_ops import check_integrity
    m = ncc_members(spark, sf_dir).select("bucket", F.col("pred").alias("cluster_id"))
    cl = m.filter(F.col("cluster_id") != 0).distinct()
    return check_integrity(m, cl)


@register("buffer_occupancy", operators=("AGG-30",), sql=BASE + """
SELECT bucket, count(*) FILTER (WHERE pred = 0) AS buffered, count(*) FILTER (WHERE pred <> 0) AS assigned
FROM mem GROUP BY bucket""")
def q_buffer_occupancy(spark, sf_dir):
    """Members of cluster 0 stand for rows that no cluster has yet."""
    from quarry.operators.buffer_ops import buffer_occupancy
    m = ncc_members(spark, sf_dir)
    return buffer_occupancy(m.select("bucket", F.when(F.col("pred") == 0, -1).otherwise(F.col("pred")).alias("cluster_id")))


@register("pool_chunks", operators=("FN-23",), sql="""
WITH v AS (SELECT vec_id // 4 AS sample_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
                  generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT sample_id, d, avg(x) AS x, count(*) AS n_chunks FROM v GROUP BY sample_id, d)
SELECT sample_id, any_value(n_chunks) AS n_chunks,
       CAST(round(sum(x * d), 6) AS DOUBLE) AS weighted, CAST(round(sum(x * x), 6) AS DOUBLE) AS sq_norm
FROM m GROUP BY sample_id""")
def q_pool_chunks(spark, sf_dir):
    """Four neighbouring vectors stand for the chunks of one sample; the
    pooled vector is compared by two sums over its components."""
    from quarry.operators.buffer_ops import pool_chunks
    e = embeddings(spark, sf_dir).withColumn("sample_id", F.expr("vec_id div 4"))
    p = pool_chunks(e, "sample_id")
    return rounded(p.select(
        "sample_id", "n_chunks",
        F.expr("aggregate(transform(embedding, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)").alias("weighted"),
        F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)").alias("sq_norm")))


@register("snapshot", operators=("PRJ-13", "JOIN-14"), sql="""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
                  row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
st AS (SELECT unnest([90, 300]) AS stage)
SELECT stage, vec_id, label, """ + ", ".join(
    f"CAST(round(v[{j + 1}], 6) AS DOUBLE) AS dim_{j}" for j in range(64)) + """
FROM e JOIN st ON e.rn <= st.stage""")
def q_snapshot(spark, sf_dir):
    from quarry.functions.vectors import wide_columns
    from quarry.operators.indexing import dense_index
    e = dense_index(embeddings(spark, sf_dir), "vec_id", "_i")
    stages = spark.range(1).select(F.explode(F.array(F.lit(90), F.lit(300))).alias("stage"))
    j = e.join(F.broadcast(stages), F.col("_i") < F.col("stage"))  # 2 literal stages
    return rounded(j.select("stage", "vec_id", "label", *wide_columns("embedding", 64)))


@register("cumulative_agreement", operators=("WIN-11", "WIN-10", "AGG-14", "AGG-15"),
          sql=BASE + """,
wmem AS (SELECT label, pred,
                CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 200) AS BIGINT) AS win
         FROM mem),
wins AS (SELECT DISTINCT win AS w FROM wmem),
cum AS (SELECT wins.w, wmem.label, wmem.pred FROM wmem JOIN wins ON wmem.win <= wins.w),""" + \
    _agreement_sql_by("cum", "label", "pred", "w") + """
SELECT g AS "window", n, CAST(round(ari, 6) AS DOUBLE) AS ari, CAST(round(nmi, 6) AS DOUBLE) AS nmi,
  CAST(round(homogeneity, 6) AS DOUBLE) AS homogeneity,
  CAST(round(completeness, 6) AS DOUBLE) AS completeness,
  CAST(round(CASE WHEN homogeneity + completeness > 0
             THEN 2 * homogeneity * completeness / (homogeneity + completeness) ELSE 0.0 END, 6)
       AS DOUBLE) AS v_measure
FROM gag""")
def q_cumulative_agreement(spark, sf_dir):
    """WIN-11: agreement over all rows seen up to each 200-row window."""
    from quarry.operators.buffer_ops import count_windows
    m = count_windows(ncc_members(spark, sf_dir), "vec_id", 200)
    return rounded(M.cumulative_agreement(m, "label", "pred", "window"))


MERGE_COS = 0.2  # fixture cut (reference default 0.8 merges nothing on this data)


@register("merge_clusters", operators=("CLU-6", "JOIN-5", "JOIN-13", "AGG-9"), sql=BASE + f""",
cm AS (
  SELECT bucket, label, list(m ORDER BY pos) AS c FROM (
    SELECT bucket, label, pos, avg(x) AS m FROM (
      SELECT bucket, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM mem) t
    GROUP BY bucket, label, pos) u
  GROUP BY bucket, label),
elig AS (SELECT bucket FROM cm GROUP BY bucket HAVING count(*) >= 3),
ed AS (SELECT a.bucket, a.label AS s, b.label AS t FROM cm a JOIN cm b
         ON a.bucket = b.bucket AND a.label < b.label
       WHERE a.bucket IN (SELECT bucket FROM elig) AND {_cos('a.c', 'b.c')} >= {MERGE_COS}),
und AS (SELECT bucket, s, t FROM ed UNION ALL SELECT bucket, t, s FROM ed),
cc AS (
  WITH RECURSIVE r(bucket, node, comp) AS (
    SELECT bucket, label, label FROM cm
    UNION
    SELECT und.bucket, und.t, r.comp FROM r JOIN und ON und.bucket = r.bucket AND und.s = r.node)
  SELECT bucket, node AS cluster_id, min(comp) AS target_id FROM r GROUP BY bucket, node),
nn AS (SELECT cc.bucket, cc.target_id, count(*) AS n_after
       FROM mem JOIN cc ON cc.bucket = mem.bucket AND cc.cluster_id = mem.label
       GROUP BY cc.bucket, cc.target_id)
SELECT cc.bucket, cc.cluster_id, cc.target_id, nn.n_after
FROM cc JOIN nn ON nn.bucket = cc.bucket AND nn.target_id = cc.target_id""")
def q_merge_clusters(spark, sf_dir):
    """CLU-6 on the (language, label) clusters: merge map and merged sizes."""
    from quarry.operators.merge import merge_similar
    m = ncc_members(spark, sf_dir).select("bucket", F.col("label").alias("cluster_id"),
                                          "embedding")
    cl = C.centroids(m, ["bucket", "cluster_id"])
    mapping, merged = merge_similar(cl, m, threshold=MERGE_COS)
    return (mapping.join(merged.select("bucket", F.col("cluster_id").alias("target_id"),
                                       F.col("n").alias("n_after")), ["bucket", "target_id"])
            .select("bucket", "cluster_id", "target_id", "n_after"))
