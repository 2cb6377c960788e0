"""Sources and sinks over the fixture tables: every query writes to the
shared checkpoint folder and reads the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.operators import sampling as SM
from quarry.plans.registry import register
from quarry.session import checkpoint_dir, materialize
from quarry.sources import io as IO
from quarry.sources.tables import table

DOC_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                         StructField("lang", StringType()), StructField("source", StringType()),
                         StructField("n_chars", LongType())])


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("scan_documents", operators=("SRC-1", "PRJ-10"), sql="""
SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang""")
def q_scan_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("json_roundtrip", operators=("SNK-1", "SRC-3", "SRC-5", "PRJ-15"), sql="""
SELECT doc_id, lang, md5(text) AS text_md5, n_chars FROM documents""")
def q_json_roundtrip(spark, sf_dir):
    d = IO.require_rows(table(spark, sf_dir, "documents"), "documents")
    path = _scratch(spark, "json")
    IO.write_json(d, path)
    back = IO.read_samples(spark, path, "json", DOC_SCHEMA)
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")


@register("tolerant_load", operators=("SRC-4",), sql="""
SELECT lang, count(*) FILTER (WHERE lang <> 'es') AS parsed,
       count(*) FILTER (WHERE lang = 'es') AS corrupt
FROM documents GROUP BY lang""")
def q_tolerant_load(spark, sf_dir):
    """JSON lines where every ``es`` record is cut short: they are kept as
    corrupt records (counted, with ``lang`` recovered from the raw line's
    position in a side column), the rest parse; a missing path is empty."""
    d = table(spark, sf_dir, "documents")
    js = F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"))
    line = F.when(F.col("lang") == "es", F.substring(js, 1, 20)).otherwise(js)
    path = _scratch(spark, "tolerant")
    d.select(line.alias("value")).write.text(path)
    schema = StructType(DOC_SCHEMA.fields + [StructField("_corrupt_record", StringType())])
    # parse once and keep the parsed rows: Spark refuses queries that read
    # only the corrupt-record column straight from raw JSON
    back = materialize(IO.read_samples(spark, path, "json", schema, tolerant=True))
    missing = IO.read_samples(spark, path + "-missing", "json", schema, tolerant=True)
    good, bad = back.filter(F.col("_corrupt_record").isNull()), \
        back.filter(F.col("_corrupt_record").isNotNull())
    good_n = good.groupBy("lang").agg(F.count(F.lit(1)).alias("parsed"))
    # a cut record still carries its id prefix: recover the language by id
    bad_ids = bad.select(F.regexp_extract("_corrupt_record", r'"doc_id":(\d+)', 1)
                         .cast("long").alias("doc_id"))
    bad_n = (bad_ids.join(d.select("doc_id", "lang"), "doc_id")
             .groupBy("lang").agg(F.count(F.lit(1)).alias("corrupt")))
    langs = d.select("lang").distinct().unionByName(missing.select("lang")).distinct()
    return (langs.join(good_n, "lang", "left").join(bad_n, "lang", "left")
            .select("lang", F.coalesce("parsed", F.lit(0)).alias("parsed"),
                    F.coalesce("corrupt", F.lit(0)).alias("corrupt")))


@register("training_set_export", operators=("SNK-2", "WIN-7", "PRJ-4"), sql="""
WITH t AS (
  SELECT doc_id, quality,
    row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn,
    count(*) OVER (PARTITION BY quality) AS n
  FROM (SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id) x)
SELECT CASE WHEN rn <= floor(n * 0.1) THEN 'test'
            WHEN rn <= floor(n * 0.1) + floor((n - floor(n * 0.1)) * 0.1111) THEN 'val'
            ELSE 'train' END AS split, count(*) AS n
FROM t GROUP BY 1""")
def q_training_set_export(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    s = SM.stratified_split(j, "quality", "doc_id", seed=42)
    s = s.select(F.concat(F.lit("Question: "), "text", F.lit("\nContext: "), "source",
                          F.lit("\nAnswer:")).alias("prompt"),
                 F.col("quality").cast("string").alias("completion"), "split")
    path = _scratch(spark, "trainset")
    IO.write_training_set(s, path)
    back = spark.read.schema("prompt string, completion string, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _summary_sql():
    from quarry.plans.cluster_plans import BASE
    return BASE + """
SELECT bucket AS bucket_id, pred AS cluster_id,
       bucket || '_cluster_' || CAST(pred AS VARCHAR) AS cluster_label, count(*) AS num_samples
FROM mem GROUP BY bucket, pred"""


@register("summary_roundtrip", operators=("SNK-7", "SNK-8", "AGG-12"),
          sql=_summary_sql())
def q_summary_roundtrip(spark, sf_dir):
    """Nested bucket -> cluster summary written as JSON and flattened back."""
    from quarry.plans.cluster_plans import ncc_members
    from quarry.functions.text import cluster_label
    m = ncc_members(spark, sf_dir).select("bucket", F.col("pred").alias("cluster_id"))
    m = m.withColumn("cluster_label", cluster_label("bucket", "cluster_id"))
    doc = IO.nest_summary(m)
    path = _scratch(spark, "summary")
    IO.write_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    return IO.flatten_summary(back)


@register("metrics_log", operators=("SNK-6",), sql="""
SELECT toxic, CAST(2 AS BIGINT) AS runs, count(*) AS n FROM labels GROUP BY toxic""")
def q_metrics_log(spark, sf_dir):
    """Class counts appended twice to a metrics log and exported as CSV."""
    lab = table(spark, sf_dir, "labels")
    m = SM.class_counts(lab, "toxic")
    path = _scratch(spark, "metrics")
    IO.append_metrics(m, path)
    IO.append_metrics(m, path)
    IO.write_csv(m, path + "-csv")
    back = spark.read.parquet(path)
    return back.groupBy("toxic").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("n"))
