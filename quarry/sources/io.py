"""Sources and sinks (SRC-1..5, SNK-1..9).

Reads always take an explicit schema for JSON (no inference pass over the
data); sinks are distributed writes (one file per task), never a single
document assembled on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: StructType | None = None, multiline: bool = False,
                 tolerant: bool = False) -> DataFrame:
    """SRC-1 / SRC-2 / SRC-3 / SRC-4.

    ``fmt``: parquet, json (JSON lines), json-array (one JSON array document
    per file; ``multiLine``).  With ``tolerant`` a missing path gives an empty
    DataFrame of ``schema`` and malformed JSON records are kept with the raw
    text in ``_corrupt_record`` (PERMISSIVE) so they can be counted.
    """
    if tolerant and schema is None:
        raise ValueError("a tolerant load needs the schema of the empty result")
    if tolerant and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt == "parquet":
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(path)
    if fmt in ("json", "json-array"):
        r = spark.read
        if schema is not None:
            s = schema
            if tolerant and CORRUPT not in schema.fieldNames():
                s = StructType(schema.fields + [StructField(CORRUPT, StringType(), True)])
            r = r.schema(s)
        r = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        if fmt == "json-array" or multiline:
            r = r.option("multiLine", True)
        return r.json(path)
    raise ValueError(f"unknown format {fmt}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """SRC-5: fail early on an empty input (one ``isEmpty`` probe)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def write_json(df: DataFrame, path: str, mode: str = "overwrite", by=None) -> None:
    """SNK-1 / SNK-2 / SNK-5: JSON lines, UTF-8 (non-ASCII kept as is),
    optionally partitioned (e.g. by ``split``)."""
    w = df.write.mode(mode)
    if by:
        w = w.partitionBy(*([by] if isinstance(by, str) else by))
    w.json(path)


def write_training_set(df: DataFrame, path: str, by: str = "split") -> None:
    """SNK-2: prompt / completion lines per split."""
    write_json(df.select("prompt", "completion", by), path, by=by)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-3: metrics table as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """SNK-6: append-only metrics log with the run time stamp."""
    df.withColumn("run_ts", F.current_timestamp()).write.mode("append").parquet(path)


def nest_summary(members: DataFrame, bucket: str = "bucket", cluster: str = "cluster_id",
                 label: str = "cluster_label") -> DataFrame:
    """SNK-7: the summary document, one row per bucket: ``bucket_id``,
    ``num_clusters`` and ``clusters`` = array of (cluster_id, cluster_label,
    num_samples).  The nesting stops at the cluster level (an array bounded
    by the bucket's cluster count); member rows stay in the flat members
    table instead of per-cluster sample lists, which could be any size."""
    per_cluster = members.groupBy(bucket, cluster, label).agg(
        F.count(F.lit(1)).alias("num_samples"))
    per_bucket = per_cluster.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("num_clusters"),
        F.sort_array(F.collect_list(F.struct(
            F.col(cluster).alias("cluster_id"), F.col(label).alias("cluster_label"),
            "num_samples"))).alias("clusters"))
    return per_bucket.select(F.col(bucket).alias("bucket_id"), "num_clusters", "clusters")


def flatten_summary(doc: DataFrame) -> DataFrame:
    """SNK-8: nested summary -> (bucket_id, cluster_id, cluster_label,
    num_samples)."""
    c = doc.select("bucket_id", F.explode("clusters").alias("c"))
    return c.select("bucket_id", "c.cluster_id", "c.cluster_label", "c.num_samples")
