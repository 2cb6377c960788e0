"""M4: sampling, balancing and splits over ``documents``, ``labels``,
``embeddings`` and ``events``.  Seeded order = ``md5('<seed>:<id>')``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import sampling as SM
from quarry.plans.registry import register
from quarry.sources.tables import table


def _doc_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "inner")


_DL = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d " \
      "JOIN labels l ON l.doc_id = d.doc_id)"


@register("cap_per_label", operators=("WIN-2",), sql=f"""
SELECT doc_id, quality, rn FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn
  FROM {_DL} t) u WHERE rn <= 50""")
def q_cap_per_label(spark, sf_dir):
    r = SM.capped_rank(_doc_labels(spark, sf_dir), "quality", "doc_id", 50, "rn")
    return r.select("doc_id", "quality", F.col("rn").cast("long").alias("rn"))


@register("class_counts", operators=("AGG-23",), sql="""
SELECT toxic, count(*) AS n, min(count(*)) OVER () AS min_count FROM labels GROUP BY toxic""")
def q_class_counts(spark, sf_dir):
    return SM.class_counts(table(spark, sf_dir, "labels"), "toxic")


@register("balance_labels", operators=("WIN-3", "AGG-23", "SRT-4"), sql=f"""
WITH t AS (SELECT doc_id, toxic, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM {_DL} x),
k AS (SELECT min(c) AS k FROM (SELECT toxic, count(*) AS c FROM t GROUP BY toxic) s)
SELECT doc_id, toxic FROM (
  SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY h) AS rn FROM t) r, k
WHERE rn <= k""")
def q_balance_labels(spark, sf_dir):
    b = SM.balance(_doc_labels(spark, sf_dir), "toxic", "doc_id", seed=42)
    return b.select("doc_id", "toxic")


@register("cluster_label_balance", operators=("WIN-5",), sql="""
WITH t AS (
  SELECT e.vec_id, e.label, d.lang, md5('42:' || CAST(e.vec_id AS VARCHAR)) AS h
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
k AS (SELECT label, least(min(c), 800) AS k
      FROM (SELECT label, lang, count(*) AS c FROM t GROUP BY label, lang) s GROUP BY label)
SELECT vec_id, r.label, lang FROM (
  SELECT vec_id, label, lang, row_number() OVER (PARTITION BY label, lang ORDER BY h) AS rn
  FROM t) r JOIN k ON k.label = r.label
WHERE rn <= k""")
def q_cluster_label_balance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    b = SM.balance(e.join(d, "vec_id"), "lang", "vec_id", seed=42, within="label", cap=800)
    return b.select("vec_id", "label", "lang")


@register("diversity_sample", operators=("WIN-6",), sql="""
SELECT doc_id, lang, n_chars FROM (
  SELECT doc_id, lang, n_chars,
         row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS pos,
         greatest(floor(count(*) OVER (PARTITION BY lang) / 10), 1) AS itv
  FROM documents) t
WHERE pos % itv = 0 AND floor(pos / itv) < 10""")
def q_diversity_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return SM.diversity_sample(d, "lang", "n_chars", "doc_id", 10).select("doc_id", "lang",
                                                                             "n_chars")


@register("stratified_split", operators=("WIN-7",), sql=f"""
SELECT doc_id, quality,
  CASE WHEN rn <= floor(n * 0.1) THEN 'test'
       WHEN rn <= floor(n * 0.1) + floor((n - floor(n * 0.1)) * 0.1111) THEN 'val'
       ELSE 'train' END AS split
FROM (
  SELECT doc_id, quality,
    row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn,
    count(*) OVER (PARTITION BY quality) AS n
  FROM {_DL} x) t""")
def q_stratified_split(spark, sf_dir):
    s = SM.stratified_split(_doc_labels(spark, sf_dir), "quality", "doc_id", seed=42)
    return s.select("doc_id", "quality", "split")


@register("leading_split", operators=("WIN-8",), sql="""
SELECT doc_id,
  CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)))
            <= floor(count(*) OVER () * 0.1) THEN 'val' ELSE 'train' END AS split
FROM documents""")
def q_leading_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    s = SM.leading_split(d, "doc_id", seed=42, frac=0.1)
    return s.select("doc_id", F.when(F.col("split") == "val", "val").otherwise("train")
                    .alias("split"))


@register("holdout", operators=("WIN-9",), sql="""
SELECT vec_id, label,
  CASE WHEN rn > n - greatest(floor(n * 0.2), 1) THEN 'val' ELSE 'train' END AS split
FROM (
  SELECT vec_id, label,
    row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR))) AS rn,
    count(*) OVER (PARTITION BY label) AS n
  FROM embeddings) t""")
def q_holdout(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return SM.holdout(e, "label", "vec_id", seed=42, ratio=0.2).select("vec_id", "label", "split")


@register("seeded_sample", operators=("SRT-3", "SRT-4"), sql="""
SELECT doc_id FROM documents ORDER BY md5('123:' || CAST(doc_id AS VARCHAR)) LIMIT 100""")
def q_seeded_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return SM.seeded_sample(d, "doc_id", 100, seed=123)


@register("id_ood_mix", operators=("SET-2", "SRT-4", "SET-1"), sql="""
WITH a AS (SELECT doc_id, 'id' AS side FROM labels WHERE quality = 1
           ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)) LIMIT 50),
b AS (SELECT doc_id, 'ood' AS side FROM labels WHERE quality = 0
      ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)) LIMIT 50),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT doc_id, side,
  CAST(row_number() OVER (ORDER BY md5('43:' || side || ':' || CAST(doc_id AS VARCHAR))) - 1
       AS BIGINT) AS mix_pos
FROM u""")
def q_id_ood_mix(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    a = lab.filter(F.col("quality") == 1).select("doc_id")
    b = lab.filter(F.col("quality") == 0).select("doc_id")
    return SM.mix(a, b, "doc_id", 50, seed=42).select("doc_id", "side", "mix_pos")


@register("topk_runs", operators=("SRT-1",), sql="""
SELECT event_type, event_id, value AS val_acc, user_id AS val_loss, rank FROM (
  SELECT event_type, event_id, value, user_id,
    row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id, event_id) AS rank
  FROM events) t WHERE rank <= 3""")
def q_topk_runs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_type", "event_id", F.col("value").alias("val_acc"),
        F.col("user_id").alias("val_loss"))
    r = SM.capped_rank(ev, "event_type",
                       [F.col("val_acc").desc(), F.col("val_loss").asc(), F.col("event_id")], 3,
                       "rank")
    return r.select("event_type", "event_id", "val_acc", "val_loss",
                    F.col("rank").cast("long").alias("rank"))
