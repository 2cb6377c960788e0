"""Sources and sinks on hand-made files."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.sources import io as IO

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_tolerant_missing_path_is_empty(spark):
    df = IO.read_samples(spark, "/nonexistent/quarry/path", "json", SCHEMA, tolerant=True)
    assert df.count() == 0 and df.schema == SCHEMA


def test_tolerant_counts_corrupt_records(spark):
    d = tempfile.mkdtemp(prefix="io-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"id": 1, "name": "é"}\n{"id": 2, "na\n{"id": 3, "name": "c"}\n')
    df = IO.read_samples(spark, d, "json", SCHEMA, tolerant=True).cache()
    assert df.filter(F.col("_corrupt_record").isNull()).count() == 2
    assert df.filter(F.col("_corrupt_record").isNotNull()).count() == 1
    assert df.filter(F.col("id") == 1).first()["name"] == "é"


def test_json_array_document(spark):
    d = tempfile.mkdtemp(prefix="io-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('[\n {"id": 1, "name": "a"},\n {"id": 2, "name": "b"}\n]\n')
    df = IO.read_samples(spark, d, "json-array", SCHEMA)
    assert sorted(r["id"] for r in df.collect()) == [1, 2]


def test_summary_round_trip(spark):
    m = spark.createDataFrame([("b1", 1, "b1_cluster_1"), ("b1", 1, "b1_cluster_1"),
                               ("b1", 2, "b1_cluster_2"), ("b2", 7, "b2_cluster_7")],
                              ["bucket", "cluster_id", "cluster_label"])
    doc = IO.nest_summary(m)
    got = {(r["bucket_id"], r["cluster_id"]): r["num_samples"]
           for r in IO.flatten_summary(doc).collect()}
    assert got == {("b1", 1): 2, ("b1", 2): 1, ("b2", 7): 1}
    assert {r["bucket_id"]: r["num_clusters"] for r in doc.collect()} == {"b1": 2, "b2": 1}


def test_csv_and_metrics_log(spark):
    d = tempfile.mkdtemp(prefix="io-")
    df = spark.createDataFrame([(1, "x")], ["a", "b"])
    IO.write_csv(df, os.path.join(d, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(d, "csv"))
    assert back.columns == ["a", "b"]
    IO.append_metrics(df, os.path.join(d, "log"))
    IO.append_metrics(df, os.path.join(d, "log"))
    assert spark.read.parquet(os.path.join(d, "log")).count() == 2


def test_buffer_ops_helpers(spark):
    from quarry.operators import buffer_ops as B
    df = spark.createDataFrame([("x #### 7\nfinal answer is 3", 4.0),
                                ("Context: c1\n\nOptions:\n0. a\nAnswer:", 0.0)], ["t", "lab"])
    r = df.select(B.extract_number("t", "gold").alias("g"), B.extract_number("t", "final").alias("f"),
                  B.extract_number("t", "nearest", "lab").alias("n")).first()
    assert (r["g"], r["f"], r["n"]) == (7, 3, 3)
    p = B.parse_sections(df.withColumnRenamed("t", "prompt")).collect()[1]
    assert p["context"] == "c1" and p["options"] == "0. a"
    d = tempfile.mkdtemp(prefix="bo-")
    for fmt in ("json", "csv", "log"):
        B.write_metrics(df, os.path.join(d, fmt), fmt)
    assert spark.read.parquet(os.path.join(d, "log")).count() == 2
    w = B.count_windows(spark.range(450).withColumnRenamed("id", "i"), "i", 200)
    assert sorted(r["window"] for r in w.groupBy("window").count().collect()) == [0, 1, 2]
