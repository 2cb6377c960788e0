"""M5: sweeps, ROC, score distributions and EMA.

Scored rows are the minimum-slice components (``trigger_plans``); the true
label is ``toxic``.  Sweeps reuse one scoring pass.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import sweeps as SW
from quarry.operators.trigger import ema, fit_band
from quarry.plans.registry import register, rounded
from quarry.plans.trigger_plans import (SCORED_CTE, SLICE_MAX_MARGIN, SLICE_THRESHOLD,
                                        sample_components, scored_samples)
from quarry.sources.tables import table


def _d(x: float) -> str:
    """An exact DuckDB double literal for a Python float."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _metric_cols(prefix: str = "") -> str:
    return ", ".join([
        f"CAST(tp AS BIGINT) AS tp", "CAST(fp AS BIGINT) AS fp",
        "CAST(fn AS BIGINT) AS fn", "CAST(tn AS BIGINT) AS tn",
        "CAST(round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) "
        "ELSE 0 END, 6) AS DOUBLE) AS accuracy",
        "CAST(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS DOUBLE) "
        "AS \"precision\"",
        "CAST(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS DOUBLE) AS recall",
        "CAST(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)"
        " AS DOUBLE) AS f1"])


_THR_SQL = SCORED_CTE + """,
grid AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold FROM range(1, 101) t(i)),
sw AS (
  SELECT g.threshold,
    count(*) FILTER (WHERE toxic = 1 AND anomaly_score >= g.threshold) AS tp,
    count(*) FILTER (WHERE toxic <> 1 AND anomaly_score >= g.threshold) AS fp,
    count(*) FILTER (WHERE toxic = 1 AND anomaly_score < g.threshold) AS fn,
    count(*) FILTER (WHERE toxic <> 1 AND anomaly_score < g.threshold) AS tn
  FROM scored, grid g WHERE toxic IS NOT NULL GROUP BY g.threshold),
swm AS (SELECT threshold, """ + _metric_cols() + " FROM sw)"


@register("threshold_sweep", operators=("JOIN-9", "FN-26", "AGG-2", "UDX-2"),
          sql=_THR_SQL + "\nSELECT * FROM swm")
def q_threshold_sweep(spark, sf_dir):
    s = scored_samples(spark, sf_dir)
    return rounded(SW.sweep_threshold(s, "toxic", "anomaly_score"))


@register("best_threshold", operators=("WIN-15",), sql=_THR_SQL + """
SELECT max(f1) AS max_f1,
  min(threshold) FILTER (WHERE f1 = (SELECT max(f1) FROM swm)) AS best_threshold,
  min(threshold) FILTER (WHERE f1 >= 0.97 * (SELECT max(f1) FROM swm)) AS robust_start,
  max(threshold) FILTER (WHERE f1 >= 0.97 * (SELECT max(f1) FROM swm)) AS robust_end
FROM swm""")
def q_best_threshold(spark, sf_dir):
    s = scored_samples(spark, sf_dir)
    sw = rounded(SW.sweep_threshold(s, "toxic", "anomaly_score"))
    return rounded(SW.best_threshold(sw))


def _weight_sql() -> str:
    rows = []
    for br, sim, i, j in SW.weight_grid():
        rows.append(f"({_d(br)}, {_d(sim)}, {_d(1.0 - 2 * br - sim)}, {i}, {j})")
    grid = "grid(br, sim, wm, br_idx, sim_idx) AS (VALUES " + ", ".join(rows) + ")"
    return SCORED_CTE + f""",
{grid},
ws AS (
  SELECT g.br, g.sim, g.wm, g.br_idx, g.sim_idx, toxic,
    (g.wm * (1 - margin / {_d(SLICE_MAX_MARGIN)}) + g.br * (1 - 1.0) + g.br * (1 - 1.0)
     + g.sim * (1 - similarity))
    * CASE WHEN similarity > band_lo AND similarity < band_hi THEN 0.5 ELSE 1.0 END AS s
  FROM comp, band, grid g WHERE toxic IS NOT NULL),
wc AS (
  SELECT br, sim, wm, br_idx, sim_idx,
    count(*) FILTER (WHERE toxic = 1 AND s >= {_d(SLICE_THRESHOLD)}) AS tp,
    count(*) FILTER (WHERE toxic <> 1 AND s >= {_d(SLICE_THRESHOLD)}) AS fp,
    count(*) FILTER (WHERE toxic = 1 AND s < {_d(SLICE_THRESHOLD)}) AS fn,
    count(*) FILTER (WHERE toxic <> 1 AND s < {_d(SLICE_THRESHOLD)}) AS tn
  FROM ws GROUP BY ALL),
wm AS (
  SELECT CAST(round(br, 6) AS DOUBLE) AS w_bleu_rouge, CAST(round(sim, 6) AS DOUBLE) AS w_similarity,
    CAST(round(1.0 - 2 * br - sim, 6) AS DOUBLE) AS w_margin, br_idx, sim_idx,
    CAST(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)
         AS DOUBLE) AS f1,
    CAST(round((tp + tn) / (tp + fp + fn + tn), 6) AS DOUBLE) AS accuracy
  FROM wc)"""


def _weight_sweep(spark, sf_dir):
    comp = sample_components(spark, sf_dir)
    band = fit_band(comp, "similarity", where=F.col("quality") == 1)
    return rounded(SW.sweep_weights(comp, "toxic", SLICE_THRESHOLD, SLICE_MAX_MARGIN,
                                    band=band))


@register("weight_sweep", operators=("JOIN-10", "FN-26"),
          sql=_weight_sql() + "\nSELECT * FROM wm")
def q_weight_sweep(spark, sf_dir):
    return _weight_sweep(spark, sf_dir)


@register("sweep_matrix", operators=("AGG-26",), sql=_weight_sql() + "\nSELECT br_idx, "
          + ", ".join(f"max(CASE WHEN sim_idx = {j} THEN f1 END) AS s{j}" for j in range(8))
          + " FROM wm GROUP BY br_idx")
def q_sweep_matrix(spark, sf_dir):
    return SW.sweep_matrix(_weight_sweep(spark, sf_dir), "f1", 8)


@register("roc_auc", operators=("WIN-13",), sql=SCORED_CTE + """,
g AS (SELECT anomaly_score AS thr, count(*) FILTER (WHERE toxic = 1) AS p,
             count(*) FILTER (WHERE toxic <> 1) AS n
      FROM scored WHERE toxic IS NOT NULL GROUP BY 1),
c AS (SELECT thr, sum(p) OVER (ORDER BY thr DESC) / sum(p) OVER () AS tpr,
             sum(n) OVER (ORDER BY thr DESC) / sum(n) OVER () AS fpr FROM g),
r AS (SELECT tpr, fpr, lag(tpr, 1, 0) OVER (ORDER BY thr DESC) AS ptpr,
             lag(fpr, 1, 0) OVER (ORDER BY thr DESC) AS pfpr FROM c)
SELECT CAST(round(sum((fpr - pfpr) * (tpr + ptpr) / 2), 6) AS DOUBLE) AS auc,
       count(*) AS n_points FROM r""")
def q_roc_auc(spark, sf_dir):
    s = scored_samples(spark, sf_dir)
    return rounded(SW.auc(s, "toxic", "anomaly_score"))


@register("roc_curve", operators=("WIN-13",), sql=SCORED_CTE + """,
g AS (SELECT anomaly_score AS thr, count(*) FILTER (WHERE toxic = 1) AS p,
             count(*) FILTER (WHERE toxic <> 1) AS n
      FROM scored WHERE toxic IS NOT NULL GROUP BY 1)
SELECT CAST(round(thr, 6) AS DOUBLE) AS thr,
       CAST(round(sum(p) OVER (ORDER BY thr DESC) / sum(p) OVER (), 6) AS DOUBLE) AS tpr,
       CAST(round(sum(n) OVER (ORDER BY thr DESC) / sum(n) OVER (), 6) AS DOUBLE) AS fpr
FROM g""")
def q_roc_curve(spark, sf_dir):
    s = scored_samples(spark, sf_dir)
    return rounded(SW.roc_curve(s, "toxic", "anomaly_score"))


@register("score_box", operators=("AGG-25", "FN-3"), sql=SCORED_CTE + """,
long AS (
  SELECT CASE WHEN quality = 1 THEN 'ID' ELSE 'OOD' END AS type, m.metric, m.score
  FROM comp, LATERAL (VALUES ('margin', margin / 0.25), ('bleu', 1.0), ('rouge', 1.0),
                             ('similarity', similarity)) m(metric, score)
  WHERE quality IS NOT NULL),
q AS (SELECT metric, type, count(*) AS n, quantile_cont(score, 0.25) AS q1,
             quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3
      FROM long GROUP BY metric, type)
SELECT q.metric, q.type, q.n, CAST(round(q1, 6) AS DOUBLE) AS q1,
  CAST(round(median, 6) AS DOUBLE) AS median, CAST(round(q3, 6) AS DOUBLE) AS q3,
  CAST(round(min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1)), 6) AS DOUBLE) AS whisker_low,
  CAST(round(max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1)), 6) AS DOUBLE) AS whisker_high,
  count(*) FILTER (WHERE score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1))
    AS n_outliers
FROM long JOIN q ON q.metric = long.metric AND q.type = long.type
GROUP BY q.metric, q.type, q.n, q1, median, q3""")
def q_score_box(spark, sf_dir):
    c = sample_components(spark, sf_dir).filter(F.col("quality").isNotNull())
    c = c.select(F.when(F.col("quality") == 1, "ID").otherwise("OOD").alias("type"),
                 (F.col("margin") / SLICE_MAX_MARGIN).alias("margin"), "bleu", "rouge",
                 "similarity")
    return rounded(SW.score_distribution(c, ["margin", "bleu", "rouge", "similarity"], "type"))


@register("ema", operators=("WIN-1",), sql="""
WITH RECURSIVE s AS (
  SELECT event_id, user_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT user_id, rn, event_id, CAST(0.1 AS DOUBLE) * value AS e FROM s WHERE rn = 1
  UNION ALL
  SELECT s.user_id, s.rn, s.event_id, CAST(0.9 AS DOUBLE) * r.e + CAST(0.1 AS DOUBLE) * s.value
  FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT event_id, user_id, CAST(round(e, 6) AS DOUBLE) AS ema_score FROM r""")
def q_ema(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return rounded(ema(ev, "value", ["ts", "event_id"], by="user_id", alpha=0.1)
                   .select("event_id", "user_id", "ema_score"))
