"""Row-level fault tolerance in one pass (FLT-14, SRC-4).

Lines are parsed once to VARIANT with ``try_`` functions, so a bad line is a row
with a reason instead of a failed job.  Good and bad rows are written together,
partitioned by ``faulty``, in the one pass; an ``Observation`` on that write counts
the reasons, without a second scan.  Spark's parser stops after a whole value, so
text behind one does not make a line malformed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Reasons, the first that fits is given.
REASONS = ("empty", "malformed", "not an object", "missing field", "wrong type")


def parsed(lines: DataFrame, fields: dict[str, str], required: tuple[str, ...], value: str = "value") -> DataFrame:
    """``value``, a column per field and ``reason`` (null for a good row).

    fields: name -> Spark type.  A field that is present and not null but does
    not cast is of the wrong type; a required one must be present and not null."""
    v = lines.withColumn("_v", F.try_parse_json(value))
    for name, kind in fields.items():
        v = v.withColumn(name, F.try_variant_get("_v", f"$.{name}", kind)).withColumn(
            f"_raw_{name}", F.try_variant_get("_v", f"$.{name}", "string"))
    lacking = _any([F.col(f"_raw_{n}").isNull() for n in required])
    wrong = _any([F.col(n).isNull() & F.col(f"_raw_{n}").isNotNull() for n in fields])
    kind = F.schema_of_variant("_v")
    reason = (F.when(F.trim(F.coalesce(value, F.lit(""))) == "", REASONS[0]).when(F.col("_v").isNull(), REASONS[1])
              .when(~kind.startswith("OBJECT"), REASONS[2]).when(lacking, REASONS[3]).when(wrong, REASONS[4]))
    return v.withColumn("reason", reason).select(F.col(value).alias("value"), *fields, "reason")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def split_faults(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write rows with a ``reason`` once; (good rows, bad rows, counts by reason)."""
    seen = Observation(f"faults-{uuid.uuid4().hex}")
    counts = [F.count_if(F.col("reason").isNull()).alias("good"),
              *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]]
    kept = F.when(F.col("reason").isNotNull(), F.col("value"))  # a good row has its fields
    rows.observe(seen, *counts).withColumns({"faulty": F.col("reason").isNotNull(), "value": kept}).write.partitionBy("faulty").parquet(path)
    # an empty table has no file to take the schema from
    back = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("faulty", BooleanType())])).parquet(path)
    good, bad = (back.where(F.col("faulty") == f).drop("faulty") for f in (False, True))
    return good.drop("reason", "value"), bad.select("value", "reason"), seen.get
