"""Session helper.

On a cluster the session already exists (spark-submit / notebook); we only
fill settings that are unset.  ``spark.checkpoint.dir`` is read from the
session; a scratch directory is set only when nothing is configured (tests,
local runs), never on a cluster that names its own shared folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we want for the workloads in this package.  On a cluster the
# caller's values win: we only set keys that are missing.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE turns a sort-merge join into a broadcast join only after the
    # small side has been materialised and measured below this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for pandas UDFs: long texts, so keep batches modest.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def get_session(master: str | None = None, app: str = "quarry",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one if none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
    else:
        b = SparkSession.builder.appName(app)
        b = b.master(master or os.environ.get("QUARRY_MASTER", "local[8]"))
        b = b.config("spark.ui.enabled", "false")
        b = b.config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEM", "16g"))
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        for k, v in _DEFAULTS.items():
            b = b.config(k, v)
        spark = b.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    conf = spark.conf
    for k, v in _DEFAULTS.items():
        if conf.get(k, None) is None:
            conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset
    (tests, a laptop) do we create a scratch folder; on a cluster the
    operator must configure a shared, fault-tolerant location.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        # A scratch folder serves a local run or a test only: on a cluster
        # executors would write to their own disks.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per context).

    Python functions are pickled by reference, so a worker has to import
    ``quarry``; an installed package or a PYTHONPATH serves too, but a plain
    checkout on the driver does not.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quarry-zip-")) / "quarry.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._quarry_shipped = True


def materialize(df):
    """Cut lineage by writing the rows as a table in the session's shared
    checkpoint folder and reading them back (never ``localCheckpoint``:
    executors can be lost; files on the shared folder survive).

    Used where one computed partitioning feeds two consumers (partition ids,
    positions) and in iterative jobs, so every consumer and every retried
    task reads the same rows.  A written table (rather than
    ``Dataset.checkpoint``) also restarts the size estimate from the file
    size: a checkpoint keeps its origin plan's estimate, and join estimates
    multiply across rounds of an iterative job.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # a known schema needs no job to find it


def materialize_all(frames: dict) -> dict:
    """``materialize`` for several tables at once: their jobs wait for one
    another's planning, not for one another."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max(1, min(len(frames), 6))) as pool:
        return dict(zip(frames, pool.map(materialize, frames.values())))
