"""Exact percentiles without gathering or sorting a group (AGG-7, AGG-8, AGG-25).

``percentile`` (exact) keeps every distinct value of a group in one aggregation
buffer, and a sort sends equal values to one task.  Here each wanted rank of a
group is selected by refining histograms: the values between a and b (at first
the group's extremes) are counted in ``BUCKETS`` buckets, with the least and the
largest value of each; the bucket that holds the rank gives the next a and b.
The ends have buckets of their own, so every round narrows the range; only
partial counts are shuffled.  A rank is found when a = b (a constant column at
once) or when at most ``FEW`` values are left, which one window ranks.

The interpolation is numpy's default (linear): h = (n - 1) p, v[lo] + (h - lo)
(v[hi] - v[lo]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.indexing import join_null_safe
from quarry.session import materialize

BUCKETS = 1024
FEW = 2_000
#: State rows (a few numbers each) that may be broadcast to the values.
SMALL_ROWS = 200_000


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _bucket():
    """1 .. BUCKETS - 2 between a and b, which have the buckets 0 and the last."""
    part = F.floor((F.col("_v") - F.col("a")) / (F.col("b") - F.col("a")) * (BUCKETS - 2))
    inner = F.least(F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)), F.lit(BUCKETS - 3)) + 1
    return F.when(F.col("_v") == F.col("a"), 0).when(F.col("_v") == F.col("b"), BUCKETS - 1).otherwise(inner)


def _select(v: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, v: the value of 0-based rank k in its group.  wanted: keys, k, a,
    b, n (values from a to b), at (rank among them)."""
    done = wanted.where("a = b").select(*keys, "k", F.col("a").alias("v"))
    left = wanted.where("a < b")
    while True:
        left = materialize(left)
        rows = left.count()
        if not rows:
            return done
        small = F.broadcast(left) if rows <= SMALL_ROWS else left
        inside = (join_null_safe(v, small, keys) if keys else v.crossJoin(small)).where("_v >= a and _v <= b")
        order = Window.partitionBy(*keys, "k").orderBy("_v")
        few = inside.where(F.col("n") <= FEW).withColumn("r", F.row_number().over(order) - 1).where("r = at")
        done = done.unionByName(few.select(*keys, "k", F.col("_v").alias("v")))
        bins = (inside.where(F.col("n") > FEW).withColumn("bin", _bucket()).groupBy(*keys, "k", "at", "bin")
                .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
        before = F.sum("c").over(Window.partitionBy(*keys, "k").orderBy("bin")) - F.col("c")
        found = materialize(bins.withColumn("before", before).where("at >= before and at < before + c")
                            .select(*keys, "k", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("c").alias("n"),
                                    (F.col("at") - F.col("before")).alias("at")))
        done = done.unionByName(found.where("a = b").select(*keys, "k", F.col("a").alias("v")))
        left = found.where("a < b")


def exact_quantiles(df: DataFrame, value: str, probs, by=None, names=None) -> DataFrame:
    """One row per group with one column per probability (default names
    ``q_<p>``) and ``n``; nulls are ignored.  Groups with no values are
    absent."""
    keys = _keys(by)
    names = list(names) if names else [f"q_{str(p).replace('.', '_')}" for p in probs]
    v = materialize(df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()))
    sizes = materialize(v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b")).where("n > 0"))
    h = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in h])))
    wanted = sizes.withColumn("k", F.explode(ranks)).withColumn("at", F.col("k"))
    found = _select(v, wanted.select(*keys, "k", "a", "b", "n", "at"), keys)
    per = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    out = join_null_safe(sizes, per, keys) if keys else sizes.crossJoin(per)  # no keys: one row each
    picks = []
    for x, name in zip(h, names):
        lo, hi = F.element_at("m", F.floor(x)), F.element_at("m", F.ceil(x))
        picks.append((lo + (hi - lo) * (x - F.floor(x))).alias(name))
    return out.select(*keys, "n", *picks)
