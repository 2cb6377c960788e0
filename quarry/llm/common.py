"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize

#: White space of the contracts: a space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def may_learn(id_col: str = "doc_id") -> Column:
    """Rows a model may learn from: a known id that is not held out."""
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """Arrow batches in, Arrow batches out; Spark bounds a batch in rows and
    bytes, so a task holds one batch of texts at a time."""
    return df.mapInArrow(fn, schema)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which a null key equals a null key; the left side's key
    columns stay.  ``right`` must share no other column name with ``left``."""
    names = {k: f"_right_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    cond = None
    for k, rk in names.items():
        c = left[k].eqNullSafe(r[rk])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (expressions over ``docs``) appear in
    ``kept`` (same names), one row per key; every column of ``docs`` and no
    other comes back.  One exchange of the documents on the keys; the window
    reuses it."""
    from pyspark.sql import Window
    mark = unused(docs, "_row")
    named = {unused(docs, k): v for k, v in keys.items()}
    left = docs.withColumns(named)
    right = kept.select(*[F.col(k).alias(n) for k, n in zip(keys, named)])
    left = null_safe_join(left, right, list(named), "left_semi")
    w = Window.partitionBy(*named).orderBy(*named)
    return (left.withColumn(mark, F.row_number().over(w)).where(F.col(mark) == 1)
            .select(*[docs[c] for c in docs.columns]))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    name = f"_q_{name}"
    while name.lower() in taken:
        name = "_" + name
    return name


__all__ = ["SPACES", "WORD", "documents", "held_out", "keep_rows", "map_batches", "materialize",
           "may_learn", "null_safe_join", "table", "text_or_empty", "unused"]
