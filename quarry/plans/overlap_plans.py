"""M3: overlap scores and answer metrics.

Pairs: ``conversations`` user turn (gold) followed by the assistant turn
(prediction), keyed by ``conv_id:turn``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.metrics import class_report, containment_accuracy, numeric_metrics
from quarry.operators.overlap import score_pairs
from quarry.plans import trigger_plans
from quarry.plans.registry import register, rounded
from quarry.plans.text_plans import PAIRS_SQL, conversation_pairs, q_decision_extract, \
    q_numeric_answer


def scored_pairs(spark, sf_dir, metrics, stem=False):
    p = conversation_pairs(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"),
        F.col("completion").alias("pred"), F.col("prompt").alias("gold"))
    return score_pairs(p, "pair_id", "pred", "gold", metrics, stem=stem)


# n-gram clipped counts in SQL: tokens, grams by lateral unnest, counts.
_GRAMS_SQL = "WITH " + PAIRS_SQL + """,
tok AS (
  SELECT conv_id || ':' || turn AS pair_id,
         list_filter(string_split_regex(completion, '\\s+'), lambda x: x <> '') AS h,
         list_filter(string_split_regex(prompt, '\\s+'), lambda x: x <> '') AS r,
         list_filter(string_split(regexp_replace(lower(completion), '[^a-z0-9]+', ' ', 'g'), ' '),
                     lambda x: x <> '') AS rh,
         list_filter(string_split(regexp_replace(lower(prompt), '[^a-z0-9]+', ' ', 'g'), ' '),
                     lambda x: x <> '') AS rr
  FROM pairs),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
g AS (
  SELECT pair_id, 'b' AS fam, n, true AS is_h, array_to_string(h[i:i + n - 1], ' ') AS gram
  FROM tok, ns, unnest(range(1, CAST(len(h) - n + 2 AS BIGINT))) AS t(i)
  UNION ALL
  SELECT pair_id, 'b', n, false, array_to_string(r[i:i + n - 1], ' ')
  FROM tok, ns, unnest(range(1, CAST(len(r) - n + 2 AS BIGINT))) AS t(i)
  UNION ALL
  SELECT pair_id, 'r', 1, true, x FROM tok, unnest(rh) AS t(x)
  UNION ALL
  SELECT pair_id, 'r', 1, false, x FROM tok, unnest(rr) AS t(x)),
c AS (
  SELECT pair_id, fam, n, gram, count(*) FILTER (WHERE is_h) AS hc,
         count(*) FILTER (WHERE NOT is_h) AS rc
  FROM g GROUP BY pair_id, fam, n, gram),
m AS (
  SELECT pair_id,
    sum(CASE WHEN fam = 'b' AND n = 1 THEN least(hc, rc) ELSE 0 END) AS b1,
    sum(CASE WHEN fam = 'b' AND n = 2 THEN least(hc, rc) ELSE 0 END) AS b2,
    sum(CASE WHEN fam = 'b' AND n = 3 THEN least(hc, rc) ELSE 0 END) AS b3,
    sum(CASE WHEN fam = 'b' AND n = 4 THEN least(hc, rc) ELSE 0 END) AS b4,
    sum(CASE WHEN fam = 'r' THEN least(hc, rc) ELSE 0 END) AS r1
  FROM c GROUP BY pair_id),
s AS (
  SELECT tok.pair_id, len(h) AS hl, len(r) AS rl, len(rh) AS rhl, len(rr) AS rrl,
         coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2, coalesce(b3, 0) AS b3,
         coalesce(b4, 0) AS b4, coalesce(r1, 0) AS r1
  FROM tok LEFT JOIN m ON m.pair_id = tok.pair_id),
sc AS (
  SELECT pair_id,
    CASE WHEN b1 = 0 OR hl = 0 THEN 0.0 ELSE
      (CASE WHEN hl > rl THEN 1.0 ELSE exp(1.0 - CAST(rl AS DOUBLE) / hl) END) * exp(
        0.25 * ln(CASE WHEN b1 > 0 THEN b1 ELSE 0.1 END / CAST(greatest(hl, 1) AS DOUBLE))
      + 0.25 * ln(CASE WHEN b2 > 0 THEN b2 ELSE 0.1 END / CAST(greatest(hl - 1, 1) AS DOUBLE))
      + 0.25 * ln(CASE WHEN b3 > 0 THEN b3 ELSE 0.1 END / CAST(greatest(hl - 2, 1) AS DOUBLE))
      + 0.25 * ln(CASE WHEN b4 > 0 THEN b4 ELSE 0.1 END / CAST(greatest(hl - 3, 1) AS DOUBLE)))
    END AS bleu4,
    CASE WHEN b1 = 0 OR hl = 0 THEN 0.0 ELSE
      (CASE WHEN hl > rl THEN 1.0 ELSE exp(1.0 - CAST(rl AS DOUBLE) / hl) END)
      * (b1 / CAST(greatest(hl, 1) AS DOUBLE)) END AS bleu1,
    CASE WHEN r1 = 0 THEN 0.0 ELSE
      2 * (r1 / CAST(greatest(rhl, 1) AS DOUBLE)) * (r1 / CAST(greatest(rrl, 1) AS DOUBLE))
      / ((r1 / CAST(greatest(rhl, 1) AS DOUBLE)) + (r1 / CAST(greatest(rrl, 1) AS DOUBLE)))
    END AS rouge1
  FROM s)"""


@register("bleu4", operators=("FN-5",), sql=_GRAMS_SQL + """
SELECT pair_id, CAST(round(bleu4, 6) AS DOUBLE) AS bleu4 FROM sc""")
def q_bleu4(spark, sf_dir):
    return rounded(scored_pairs(spark, sf_dir, ("bleu4",)).select("pair_id", "bleu4"))


@register("bleu1", operators=("FN-6",), sql=_GRAMS_SQL + """
SELECT pair_id, CAST(round(bleu1, 6) AS DOUBLE) AS bleu1 FROM sc""")
def q_bleu1(spark, sf_dir):
    return rounded(scored_pairs(spark, sf_dir, ("bleu1",)).select("pair_id", "bleu1"))


@register("rouge1", operators=("FN-8",), sql=_GRAMS_SQL + """
SELECT pair_id, CAST(round(rouge1, 6) AS DOUBLE) AS rouge1 FROM sc""")
def q_rouge1(spark, sf_dir):
    return rounded(scored_pairs(spark, sf_dir, ("rouge1",)).select("pair_id", "rouge1"))


# LCS in SQL (Hunt and Szymanski): t[k] is the smallest place in the reference at
# which a common subsequence of k tokens can end.  One step takes the next token
# of the prediction, whose places in the reference are p: t[k] becomes the
# smallest place of p after the old t[k - 1], if that is smaller.
_ROUGEL_SQL = _GRAMS_SQL + """,
walk(pair_id, rh, rr, i, t) AS (
  SELECT pair_id, rh, rr, 0, []::BIGINT[] FROM tok
  UNION ALL
  SELECT pair_id, rh, rr, i + 1, list_filter(list_transform(range(1, len(t) + 2), lambda k: least(t[k],
           list_min(list_filter(p, lambda q: q > coalesce(t[k - 1], 0))))), lambda x: x IS NOT NULL)
  FROM (SELECT *, list_filter(range(1, len(rr) + 1), lambda j: rr[j] = rh[i + 1]) AS p FROM walk WHERE i < len(rh)) w),
lcs AS (SELECT pair_id, len(rh) AS hn, len(rr) AS rn, len(t) AS n FROM walk WHERE i = len(rh)),
rl AS (SELECT pair_id, CASE WHEN hn = 0 OR rn = 0 OR n = 0 THEN 0.0 ELSE
         2 * (n / hn::DOUBLE) * (n / rn::DOUBLE) / ((n / hn::DOUBLE) + (n / rn::DOUBLE)) END AS rougel FROM lcs)"""
_ROUGEL_SQL = _ROUGEL_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


@register("rougel", operators=("FN-7", "UDX-1"), sql=_ROUGEL_SQL + """
SELECT pair_id, CAST(round(rougel, 6) AS DOUBLE) AS "rougeL" FROM rl""")
def q_rougel(spark, sf_dir):
    return rounded(scored_pairs(spark, sf_dir, ("rougeL",)).select("pair_id", "rougeL"))


@register("overlap_means", operators=("AGG-24", "FN-5", "FN-7"), sql=_ROUGEL_SQL + """
SELECT CAST(round(avg(rougel), 6) AS DOUBLE) AS "avg_rougeL_f1", CAST(round(avg(bleu4), 6) AS DOUBLE) AS avg_bleu4,
       count(*) AS n_pairs
FROM sc JOIN rl USING (pair_id)""")
def q_overlap_means(spark, sf_dir):
    """AGG-24 without stemming, which SQL can follow."""
    from quarry.operators.buffer_ops import overlap_report
    p = conversation_pairs(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"), F.col("completion").alias("pred"), F.col("prompt").alias("gold"))
    return rounded(overlap_report(p, "pair_id", "pred", "gold", stem=False))


@register("trigger_four", operators=("FN-9", "FN-5", "FN-7", "JOIN-11"), sql=_ROUGEL_SQL + "," + trigger_plans._COMPONENTS_SQL
          .split("scored AS (")[0].rstrip().rstrip(",") + """,
four AS (
  SELECT p.conv_id || ':' || p.turn AS pair_id, p.conv_id, p.turn, comp.bucket, margin, quality, toxic, band_lo, band_hi,
         CASE WHEN trim(coalesce(p.prompt, '')) = '' THEN 1.0 ELSE sc.bleu4 END AS bleu,
         CASE WHEN trim(coalesce(p.prompt, '')) = '' THEN 1.0 ELSE rl.rougel END AS rouge,
         CASE WHEN trim(coalesce(p.prompt, '')) = '' THEN 1.0 ELSE similarity END AS similarity
  FROM pairs p JOIN sc ON sc.pair_id = p.conv_id || ':' || p.turn JOIN rl ON rl.pair_id = sc.pair_id
  LEFT JOIN comp ON comp.sample_id = p.conv_id, band),
x AS (
  SELECT *, (0.33 * (1 - margin / 0.25) + 0.12 * (1 - bleu) + 0.23 * (1 - rouge) + 0.33 * (1 - similarity))
            * CASE WHEN similarity > band_lo AND similarity < band_hi THEN 0.5 ELSE 1.0 END AS score FROM four)
SELECT pair_id, conv_id, turn, bucket, CAST(round(margin, 6) AS DOUBLE) AS margin, CAST(round(bleu, 6) AS DOUBLE) AS bleu,
       CAST(round(rouge, 6) AS DOUBLE) AS rouge, CAST(round(similarity, 6) AS DOUBLE) AS similarity,
       CAST(round(score, 6) AS DOUBLE) AS anomaly_score, score >= 0.3 AS "trigger", quality, toxic
FROM x""")
def q_trigger_four(spark, sf_dir):
    """``trigger_full`` without stemming, which SQL can follow: all four terms live."""
    return trigger_plans.full_triggers(spark, sf_dir, stem=False)


@register("rouge_stemmed", operators=("FN-7", "FN-8"))
def q_rouge_stemmed(spark, sf_dir):
    """ROUGE-1 and ROUGE-L F with Porter stemming, as the reference scores
    (no SQL oracle: DuckDB has no stemmer offline; tests use the published
    stemmer examples and a brute-force LCS)."""
    s = scored_pairs(spark, sf_dir, ("rouge1", "rougeL"), stem=True)
    return rounded(s.select("pair_id", F.col("rouge1").alias("rouge1_stem"),
                            F.col("rougeL").alias("rougeL_stem")))


@register("overlap_report", operators=("AGG-24", "FN-5", "FN-7"))
def q_overlap_report(spark, sf_dir):
    """AGG-24: mean scores over the whole pair table."""
    s = scored_pairs(spark, sf_dir, ("bleu4", "rougeL"), stem=True)
    return rounded(s.agg(F.avg("rougeL").alias("avg_rougeL_f1"), F.avg("bleu4").alias("avg_bleu4"),
                         F.count(F.lit(1)).alias("n_pairs")))


_DEC_SQL = "WITH " + PAIRS_SQL + """,
o AS (
  SELECT conv_id, turn, prompt, prompt || chr(10) || 'Answer: ' || completion AS output_text,
         CASE WHEN length(prompt) % 2 = 0 THEN 'yes' ELSE 'no' END AS ground_truth
  FROM pairs),
a AS (
  SELECT conv_id, turn, ground_truth,
         CASE WHEN contains(lower(string_split(replace(output_text, prompt, ''), 'Answer:')[-1]),
                            'yes') THEN 'yes' ELSE 'no' END AS predicted_decision
  FROM o),
cont AS (SELECT ground_truth AS t, predicted_decision AS p, count(*) AS c FROM a GROUP BY 1, 2),
cls AS (SELECT t AS cls FROM cont UNION SELECT p FROM cont),
per AS (
  SELECT cls.cls,
    coalesce((SELECT sum(c) FROM cont WHERE t = cls.cls), 0) AS support,
    coalesce((SELECT sum(c) FROM cont WHERE p = cls.cls), 0) AS predicted,
    coalesce((SELECT sum(c) FROM cont WHERE t = cls.cls AND p = cls.cls), 0) AS tp
  FROM cls),
pr AS (
  SELECT cls, support, tp,
    CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS "precision",
    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM per),
f AS (
  SELECT *, CASE WHEN "precision" + recall > 0
                 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1
  FROM pr),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg("precision") AS mp, avg(recall) AS mr,
               avg(f1) AS mf, sum("precision" * support) AS wp, sum(recall * support) AS wr,
               sum(f1 * support) AS wf FROM f)
SELECT cls, CAST(support AS BIGINT) AS support, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f
UNION ALL SELECT 'accuracy', CAST(n AS BIGINT), round(tp / n, 6), round(tp / n, 6), round(tp / n, 6)
  FROM tot
UNION ALL SELECT 'macro avg', CAST(n AS BIGINT), round(mp, 6), round(mr, 6), round(mf, 6) FROM tot
UNION ALL SELECT 'weighted avg', CAST(n AS BIGINT), round(wp / n, 6), round(wr / n, 6),
  round(wf / n, 6) FROM tot"""


@register("class_report", operators=("AGG-3", "AGG-4", "FN-16"), sql=_DEC_SQL)
def q_class_report(spark, sf_dir):
    d = q_decision_extract(spark, sf_dir)
    return rounded(class_report(d, "ground_truth", "predicted_decision"))


@register("numeric_metrics", operators=("AGG-5", "AGG-6", "FLT-9"), sql="""
WITH d AS (SELECT doc_id, lang FROM documents),
x AS (
  SELECT d.lang,
    CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END AS run_id, n.pred, n.gold
  FROM ({numeric}) n JOIN d ON d.doc_id = n.doc_id)
SELECT run_id,
  CAST(round(avg(CASE WHEN pred IS NOT NULL AND gold IS NOT NULL
                      THEN CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END END), 6) AS DOUBLE)
    AS exact_match,
  CAST(round(avg(CASE WHEN pred IS NOT NULL AND gold IS NOT NULL
                      THEN abs(CAST(pred AS DOUBLE) - gold) END), 6) AS DOUBLE) AS mae,
  CAST(round(avg(CASE WHEN pred IS NOT NULL AND gold IS NOT NULL
                      THEN (CAST(pred AS DOUBLE) - gold) * (CAST(pred AS DOUBLE) - gold) END), 6)
       AS DOUBLE) AS mse,
  count(*) FILTER (WHERE pred IS NOT NULL AND gold IS NOT NULL) AS valid_predictions,
  count(*) AS total_samples,
  CAST(round(count(*) FILTER (WHERE pred IS NOT NULL AND gold IS NOT NULL)
             / CAST(count(*) AS DOUBLE), 6) AS DOUBLE) AS numeric_extraction_rate
FROM x GROUP BY run_id""")
def q_numeric_metrics(spark, sf_dir):
    from quarry.sources.tables import table
    n = q_numeric_answer(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    x = n.join(d, "doc_id").withColumn(
        "run_id", F.when(F.col("lang") == "en", 0).otherwise(1))
    return rounded(numeric_metrics(x, "gold", "pred", by="run_id"))


@register("containment", operators=("AGG-27", "FN-17"), sql="WITH " + PAIRS_SQL + """,
x AS (SELECT 'conversations' AS origin, prompt AS gold, completion AS pred FROM pairs
      UNION ALL SELECT 'documents', lang, text FROM documents)
SELECT origin, CAST(round(avg(CASE WHEN contains(lower(pred), lower(gold))
                       THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS DOUBLE) AS containment_accuracy,
       count(*) AS n
FROM x GROUP BY origin""")
def q_containment(spark, sf_dir):
    """The whole gold text in the whole prediction, per origin."""
    from quarry.sources.tables import table
    pairs = conversation_pairs(spark, sf_dir).select(
        F.lit("conversations").alias("origin"), F.col("prompt").alias("gold"), F.col("completion").alias("pred"))
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("lang").alias("gold"), F.col("text").alias("pred"))
    return rounded(containment_accuracy(pairs.unionByName(docs), "gold", "pred", by="origin"))


def _fill_numeric_sql():
    import quarry.plans.registry as R
    spec = R.REGISTRY["numeric_metrics"]
    inner = R.REGISTRY["numeric_answer"].sql
    spec.sql = spec.sql.replace("{numeric}", inner)


_fill_numeric_sql()
