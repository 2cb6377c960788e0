"""Minimum slice (M1): trigger evaluation over the fixture tables.

Column roles (FIXTURES.md section 4): a sample is a ``documents`` row joined to
its ``embeddings`` row; margin = top-2 gap of the embedding (logits stand-in);
similarity = cosine to the centroid of its ``label``; bleu = rouge = 1;
band = p5..p95 of similarity over ``quality = 1``; positives = ``toxic = 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import structure_tag
from quarry.functions.vectors import cosine, logit_margin
from quarry.operators.centroids import centroids, with_centroid
from quarry.operators.metrics import binary_metrics
from quarry.operators.trigger import fit_band, score_anomaly
from quarry.plans.registry import register, rounded
from quarry.sources.tables import embeddings, table

# Fixed values for the minimum slice (FIXTURES.md section 4).
SLICE_MAX_MARGIN = 0.25
SLICE_THRESHOLD = 0.3
SLICE_WEIGHTS = {"margin": 0.33, "bleu": 0.12, "rouge": 0.23, "similarity": 0.33}


def sample_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: id, bucket, margin, similarity, labels."""
    e = embeddings(spark, sf_dir)
    cents = centroids(e, "label", "embedding")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), structure_tag("source").alias("bucket"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_id"), "quality", "toxic")
    s = (with_centroid(e, cents, "label")
         .select(F.col("vec_id").alias("sample_id"), "label",
                 logit_margin("embedding").alias("margin"),
                 cosine("embedding", "centroid").alias("similarity")))
    return (s.join(docs, "sample_id", "inner")
            .join(labels, "sample_id", "left")
            .withColumn("bleu", F.lit(1.0)).withColumn("rouge", F.lit(1.0)))


def scored_samples(spark: SparkSession, sf_dir: str, use_band: bool = True) -> DataFrame:
    s = sample_components(spark, sf_dir)
    band = fit_band(s, "similarity", where=F.col("quality") == 1) if use_band else None
    return score_anomaly(s, band, weights=SLICE_WEIGHTS, max_margin=SLICE_MAX_MARGIN,
                         threshold=SLICE_THRESHOLD)


_COMPONENTS_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cen AS (
  SELECT label, list(m ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) t
    GROUP BY label, pos) u
  GROUP BY label),
comp AS (
  SELECT e.vec_id AS sample_id,
         coalesce(nullif(lower(trim(d.source)), ''), 'unknown') AS bucket,
         e.label,
         CASE WHEN len(e.v) = 1 THEN e.v[1]
              ELSE list_sort(e.v, 'DESC')[1] - list_sort(e.v, 'DESC')[2] END AS margin,
         CASE WHEN sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(cen.c, cen.c)) > 0
              THEN list_dot_product(e.v, cen.c)
                   / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(cen.c, cen.c)))
              ELSE 0.0 END AS similarity,
         l.quality, l.toxic
  FROM e JOIN cen ON e.label = cen.label
  JOIN documents d ON d.doc_id = e.vec_id
  LEFT JOIN labels l ON l.doc_id = e.vec_id),
band AS (
  SELECT quantile_cont(similarity, 0.05) AS band_lo, quantile_cont(similarity, 0.95) AS band_hi
  FROM comp WHERE quality = 1),
scored AS (
  SELECT comp.*,
         (0.33 * (1 - margin / 0.25) + 0.12 * (1 - 1.0) + 0.23 * (1 - 1.0)
          + 0.33 * (1 - similarity))
         * CASE WHEN similarity > band_lo AND similarity < band_hi THEN 0.5 ELSE 1.0 END
           AS anomaly_score
  FROM comp, band)
"""

SCORED_CTE = "WITH " + _COMPONENTS_SQL


@register("trigger_samples", operators=("FN-1", "FN-2", "FN-3", "FN-9", "AGG-7", "AGG-9",
                                         "JOIN-11", "FLT-12"),
          sql=SCORED_CTE + """
SELECT sample_id, bucket, CAST(round(margin, 6) AS DOUBLE) AS margin,
       CAST(round(similarity, 6) AS DOUBLE) AS similarity,
       CAST(round(anomaly_score, 6) AS DOUBLE) AS anomaly_score,
       anomaly_score >= 0.3 AS "trigger", quality, toxic
FROM scored""")
def q_trigger_samples(spark, sf_dir):
    s = scored_samples(spark, sf_dir)
    return rounded(s.select("sample_id", "bucket", "margin", "similarity", "anomaly_score",
                            "trigger", "quality", "toxic"))


@register("trigger_eval", operators=("AGG-1", "AGG-2", "FLT-5", "FLT-13", "JOIN-1"),
          sql=SCORED_CTE + """
, m AS (
  SELECT bucket, count(*) AS n,
         count(*) FILTER (WHERE toxic = 1 AND anomaly_score >= 0.3) AS tp,
         count(*) FILTER (WHERE toxic <> 1 AND anomaly_score >= 0.3) AS fp,
         count(*) FILTER (WHERE toxic = 1 AND anomaly_score < 0.3) AS fn,
         count(*) FILTER (WHERE toxic <> 1 AND anomaly_score < 0.3) AS tn
  FROM scored WHERE toxic IS NOT NULL GROUP BY bucket)
SELECT bucket, n, tp, fp, fn, tn,
  CAST(round(CASE WHEN n > 0 THEN (tp + fp) / n ELSE 0 END, 6) AS DOUBLE) AS trigger_rate,
  CAST(round(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0 END, 6) AS DOUBLE) AS accuracy,
  CAST(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS DOUBLE) AS "precision",
  CAST(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS DOUBLE) AS recall,
  CAST(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)
       AS DOUBLE) AS f1
FROM m""")
def q_trigger_eval(spark, sf_dir):
    s = scored_samples(spark, sf_dir)
    return rounded(binary_metrics(s, "toxic", "trigger", by="bucket"))


def pair_scores(spark: SparkSession, sf_dir: str, stem: bool = True) -> DataFrame:
    """pair_id, conv_id, turn, gold, bleu, rouge of every conversation pair:
    BLEU-4 and (stemmed) ROUGE-L of the answer against the user turn."""
    from quarry.operators.overlap import score_pairs
    from quarry.plans.text_plans import conversation_pairs
    pairs = conversation_pairs(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "conv_id", "turn",
        F.col("completion").alias("pred"), F.col("prompt").alias("gold"))
    scores = score_pairs(pairs, "pair_id", "pred", "gold", ("bleu4", "rougeL"), stem=stem)
    return (pairs.select("pair_id", "conv_id", "turn", "gold").join(scores, "pair_id")
            .withColumnsRenamed({"bleu4": "bleu", "rougeL": "rouge"}))


FULL_COLUMNS = ("pair_id", "conv_id", "turn", "bucket", "margin", "bleu", "rouge", "similarity",
                "anomaly_score", "trigger", "quality", "toxic")


def full_triggers(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    """Every conversation pair with all four terms live: its texts' overlap,
    margin and similarity from the vector of its conversation (null, and so
    the score, where there is none)."""
    comp = sample_components(spark, sf_dir)
    band = fit_band(comp, "similarity", where=F.col("quality") == 1)
    s = pair_scores(spark, sf_dir, stem).join(
        comp.drop("bleu", "rouge").withColumnRenamed("sample_id", "conv_id"), "conv_id", "left")
    return rounded(score_anomaly(s, band, weights=SLICE_WEIGHTS, max_margin=SLICE_MAX_MARGIN,
                                 threshold=SLICE_THRESHOLD, gold="gold").select(*FULL_COLUMNS))


@register("trigger_full", operators=("FN-9", "FN-5", "FN-7", "JOIN-11"))
def q_trigger_full(spark, sf_dir):
    """All four terms with stemmed ROUGE-L, as the reference scores."""
    return full_triggers(spark, sf_dir, stem=True)


@register("margin", operators=("FN-2", "SRT-5", "FN-3", "PRJ-14"), sql="""
SELECT vec_id,
       CAST(round(CASE WHEN len(v) = 1 THEN v[1]
                  ELSE list_sort(v, 'DESC')[1] - list_sort(v, 'DESC')[2] END, 6) AS DOUBLE)
         AS margin,
       CAST(round((CASE WHEN len(v) = 1 THEN v[1]
                   ELSE list_sort(v, 'DESC')[1] - list_sort(v, 'DESC')[2] END) / 5.0, 6)
            AS DOUBLE) AS margin_norm
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) t""")
def q_margin(spark, sf_dir):
    from quarry.functions.vectors import normalised_margin
    e = embeddings(spark, sf_dir)
    m = logit_margin("embedding")
    return rounded(e.select("vec_id", m.alias("margin"),
                            normalised_margin(m, 5.0).alias("margin_norm")))


@register("id_band", operators=("AGG-7",), sql=SCORED_CTE + """
SELECT CAST(round(band_lo, 6) AS DOUBLE) AS band_lo, CAST(round(band_hi, 6) AS DOUBLE) AS band_hi,
       (SELECT count(*) FROM comp WHERE quality = 1) AS n_id
FROM band""")
def q_id_band(spark, sf_dir):
    s = sample_components(spark, sf_dir)
    idrows = s.filter(F.col("quality") == 1)
    band = fit_band(idrows, "similarity")
    n = idrows.agg(F.count(F.lit(1)).alias("n_id"))
    return rounded(band.crossJoin(n))  # one row x one row
