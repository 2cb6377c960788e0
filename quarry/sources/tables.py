"""Table access for the fixture layout ``{sf_dir}/{name}.parquet`` (SRC-1).

Reads are lazy; Catalyst prunes columns and pushes filters into the Parquet
scan, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the vector cast to ``array<double>`` once at the
    scan (float32 arithmetic differs from double in the 8th digit)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the fixture tables as temp views for ``spark.sql``."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
