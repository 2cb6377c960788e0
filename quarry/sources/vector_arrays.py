"""Vector snapshots as compressed array files (SNK-4): a batch data source.

``df.write.format("vector_arrays").option("stages", ...)`` writes the columns
(stage int, id long, label int, vector array<double>) as ``.npz`` files of at most
``rowsPerFile`` rows of one stage.  A task only adds files under names of its own
and reports them; the commit writes ``_committed.json``, the list of the files of
the tasks that Spark accepted, in one step.  Reading goes by that list, so files
of a failed or repeated task are never seen, and a snapshot without the list does
not exist.  Each file is read by a task of its own, with its vectors as they were.

Paths go through Arrow's file systems, so any store that Arrow knows serves; a
plain path is a folder that driver and executors share.  A null vector or label
comes back as null; vectors of one file may differ in length.
"""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MANIFEST = "_committed.json"
SCHEMA = "stage int, id long, label int, vector array<double>"


def _open(path: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, rows_per_file: int, overwrite: bool):
        self.path, self.most, self.overwrite = path, rows_per_file, overwrite

    def write(self, rows) -> Written:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        held: dict[int, list] = {}
        files, total = [], 0

        def put(stage: int) -> None:
            part = held.pop(stage)
            vectors = [r[3] for r in part]
            flat = np.array([x for v in vectors if v is not None for x in v], dtype=np.float64)
            sizes = np.array([-1 if v is None else len(v) for v in vectors], dtype=np.int64)
            buf = io.BytesIO()
            np.savez_compressed(buf, id=np.array([r[1] for r in part], dtype=np.int64), flat=flat, sizes=sizes,
                                label=np.array([0 if r[2] is None else r[2] for r in part], dtype=np.int32),
                                labelled=np.array([r[2] is not None for r in part]))
            name = f"stage-{stage}-{uuid.uuid4().hex}.npz"
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(buf.getvalue())
            files.append({"name": name, "stage": stage, "rows": len(part)})

        for r in rows:
            held.setdefault(r[0], []).append(r)
            total += 1
            if len(held[r[0]]) == self.most:
                put(r[0])
        for stage in list(held):
            put(stage)
        return Written(files, total)

    def commit(self, messages) -> None:
        fs, folder = _open(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite and fs.get_file_info(f"{folder}/{MANIFEST}").is_file:
            files += _listed(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps(files).encode())
        fs.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages) -> None:
        fs, folder = _open(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                fs.delete_file(f"{folder}/{f['name']}")


def _listed(path: str) -> list[dict]:
    fs, folder = _open(path)
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


class ArrayFile(InputPartition):
    def __init__(self, name: str, stage: int):
        self.name, self.stage = name, stage


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [ArrayFile(f["name"], f["stage"]) for f in _listed(self.path)] or [ArrayFile("", 0)]

    def read(self, partition):
        if not partition.name:
            return
        fs, folder = _open(self.path)
        with fs.open_input_stream(f"{folder}/{partition.name}") as f:
            a = np.load(io.BytesIO(f.read()))
        ends = np.cumsum(np.maximum(a["sizes"], 0))
        for i, size in enumerate(a["sizes"].tolist()):
            vector = None if size < 0 else a["flat"][ends[i] - size: ends[i]].tolist()
            yield partition.stage, int(a["id"][i]), int(a["label"][i]) if a["labelled"][i] else None, vector


class VectorArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("rowsperfile", 65_536)), overwrite)


def write_snapshots(df, path: str, vec: str, dim: int, stage: str = "stage", id_col: str = "vec_id", label: str = "label") -> None:
    """Array files at ``path``/arrays and the wide CSV (dim_0.., label) at ``path``/wide."""
    from pyspark.sql import functions as F

    from quarry.functions.vectors import wide_columns
    from quarry.sources.io import write_csv
    df.sparkSession.dataSource.register(VectorArrays)
    rows = df.select(F.col(stage).cast("int").alias("stage"), F.col(id_col).cast("long").alias("id"),
                     F.col(label).cast("int").alias("label"), F.col(vec).cast("array<double>").alias("vector"))
    rows.write.format("vector_arrays").mode("append").save(f"{path}/arrays")
    write_csv(df.select(stage, id_col, *wide_columns(vec, dim), label), f"{path}/wide")


def read_snapshots(spark, path: str):
    """(stage, id, label, vector) of the committed array files."""
    spark.dataSource.register(VectorArrays)
    return spark.read.format("vector_arrays").load(f"{path}/arrays")
