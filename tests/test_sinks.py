"""Array-file snapshots and row faults."""

import json
import os

from pyspark.sql import functions as F

from quarry.session import checkpoint_dir
from quarry.sources.faults import REASONS, parsed, split_faults
from quarry.sources.vector_arrays import MANIFEST, VectorArrays, Written, Writer, read_snapshots


def _folder(spark, name):
    import uuid
    return f"{checkpoint_dir(spark).replace('file:', '')}/{name}-{uuid.uuid4().hex}"


def test_snapshot_round_trip_and_commit(spark):
    spark.dataSource.register(VectorArrays)
    rows = [(1, i, i % 3 if i % 5 else None, [i / 7, -1e300, 5e-324][: i % 4] if i % 6 else None) for i in range(50)]
    rows += [(2, -9, 1, [0.1])]
    df = spark.createDataFrame(rows, "stage int, id long, label int, vector array<double>")
    path = _folder(spark, "snap")
    df.write.format("vector_arrays").option("rowsPerFile", 4).mode("append").save(f"{path}/arrays")
    # what no commit lists does not exist
    Writer(f"{path}/arrays", 4, False).write([(1, 999, 0, [1.0])])
    back = {tuple(map(repr, r)) for r in read_snapshots(spark, path).collect()}
    assert back == {tuple(map(repr, r)) for r in df.collect()} and len(back) == 51
    listed = json.load(open(f"{path}/arrays/{MANIFEST}"))
    assert sum(f["rows"] for f in listed) == 51 and max(f["rows"] for f in listed) <= 4
    df.limit(2).write.format("vector_arrays").mode("overwrite").save(f"{path}/arrays")
    assert read_snapshots(spark, path).count() == 2


def test_abort_removes_what_tasks_reported(tmp_path):
    w = Writer(str(tmp_path / "a"), 10, False)
    done = w.write([(1, 1, 1, [1.0])])
    assert isinstance(done, Written) and len(os.listdir(tmp_path / "a")) == 1
    w.abort([done, None])
    assert os.listdir(tmp_path / "a") == []


def test_faults(spark):
    lines = ['{"id": 1, "name": "a", "n": 2.5}', '{"id": 2}', '{"id": "x", "name": "b"}', '{"name": "c"}', "[1, 2]", "7", "null",
             "", "  ", '{"id": 3, "name": "d"', '{"id": null, "name": "e"}', '{"id": 4, "name": "é\\n", "n": "1.5", "more": {"k": [1]}}', None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = parsed(df, {"id": "bigint", "name": "string", "n": "double"}, ("id", "name"))
    good, bad, counts = split_faults(rows, _folder(spark, "faults"))
    assert sorted((r.id, r.name, r.n) for r in good.collect()) == [(1, "a", 2.5), (4, "é\n", 1.5)]
    got = {(r.value, r.reason) for r in bad.collect()}
    assert got == {(lines[1], "missing field"), (lines[2], "wrong type"), (lines[3], "missing field"), ("[1, 2]", "not an object"),
                   ("7", "not an object"), ("null", "not an object"), ("", "empty"), ("  ", "empty"), (lines[9], "malformed"),
                   (lines[10], "missing field"), (None, "empty")}
    assert counts == {"good": 2, "empty": 3, "malformed": 1, "not an object": 3, "missing field": 3, "wrong type": 1}
    assert set(counts) == {"good", *REASONS}
    empty = split_faults(rows.where(F.lit(False)), _folder(spark, "none"))
    assert empty[2]["good"] == 0
