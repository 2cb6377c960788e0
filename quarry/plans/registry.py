"""Registry of the queries this package answers over the fixture tables.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with, when
the operator is SQL-expressible, an ANSI SQL text that DuckDB runs over the
same tables.  Column names are identical on both sides; doubles are rounded
to ``DIGITS`` places on both sides so value hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None, operators: tuple[str, ...] = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, tuple(operators))
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column so both engines hash the same values."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
