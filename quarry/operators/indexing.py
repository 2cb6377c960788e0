"""Distributed consecutive row index (PRJ-12, PRJ-16, WIN-10).

``Window.orderBy(...)`` without a partition key moves every row to one task.
Instead: range-partition by the order key (sampled bounds, one shuffle),
count rows per partition (a table with one row per partition), turn the
counts into offsets, and number rows inside each partition.  The result is the
same 0-based position a global sort gives, computed in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_index(df: DataFrame, order, out: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ``order`` (a column name or list;
    make it unique, ties break arbitrarily otherwise)."""
    from quarry.operators.sampling import group_rank
    r = group_rank(df, None, order, "_rank1", partitions=partitions)
    return r.withColumn(out, (F.col("_rank1") - 1).cast("long")).drop("_rank1")


def distinct_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Sorted distinct values of ``col`` -> 0..k-1, joined back onto ``df``."""
    codes = dense_index(df.select(col).distinct(), col, out)
    return df.join(codes.withColumn(out, F.col(out).cast("int")), col, "left")


def running_total(df: DataFrame, order, sums, by=None, prefix: str = "cum_",
                  partitions: int | None = None) -> DataFrame:
    """Inclusive prefix sums of ``sums`` in ``order`` within ``by`` groups.

    Distributed scan: range-partition on (by, order); each partition's rows
    move to one task (a chunk of about rows / partitions, however large a
    group is) and get local running sums; per-(partition, group) totals, a
    table of at most #partitions + #groups rows, give each chunk its offset.
    ``order`` must be unique within a group (ties would split arbitrarily).
    """
    from pyspark.sql import Window
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    order = [order] if not isinstance(order, (list, tuple)) else list(order)
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    sums = [sums] if isinstance(sums, str) else list(sums)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from quarry.session import materialize
    parted = materialize(df.repartitionByRange(n, *[F.col(k) for k in keys], *ocols)
                         .withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *keys).orderBy(*ocols).rowsBetween(Window.unboundedPreceding, 0)
    local = parted.select("*", *[F.sum(c).over(w).alias(f"_l_{c}") for c in sums])
    stats = parted.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wo = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0))
                                         .alias(f"_o_{c}") for c in sums])
    res = join_null_safe(local, offs, ["_pid", *keys])
    return res.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(prefix + c)
                                     for c in sums])


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (``<=>``), keeping one
    copy of the key columns: group keys may be null and must not drop rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                       for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
