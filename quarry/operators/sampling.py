"""Sampling, balancing and splits (WIN-2..9, SRT-1..4, SET-2, AGG-23).

Order is always reproducible: a seeded hash ``md5(seed:id)`` (SRT-4), never
``rand()``, so a re-executed task (lost executor) draws the same rows and the
DuckDB oracle can replay the draw.

Two ranking strategies:

* ``capped_rank``: ``row_number <= n`` with a literal ``n``.  Catalyst adds a
  partial ``WindowGroupLimit`` before the shuffle, so at most ``n`` rows per
  group leave each map task; right for small caps.
* ``group_rank``: exact rank inside a group for *proportional* selections
  (balance to the smallest class, stratified fractions, hold-outs), where a
  plain window would sort a hot group (say a third of all rows) in one task.
  Rows are range-partitioned on (group, order), so a big group spans many
  partitions; each partition numbers its rows locally, and a small table of
  per-(partition, group) counts supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def hash_order(id_col, seed: int = 42) -> Column:
    """SRT-4: ``md5('<seed>:<id>')``, a seeded, engine-independent order."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def capped_rank(df: DataFrame, by, order, n: int, out: str = "rn") -> DataFrame:
    """WIN-2 / WIN-4 / SRT-1: first ``n`` rows per group (1-based ``out``)."""
    order = order if isinstance(order, (list, tuple)) else [order]
    w = Window.partitionBy(*_keys(by)).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def group_rank(df: DataFrame, by, order, out: str = "rn", count_out: str | None = None,
               partitions: int | None = None) -> DataFrame:
    """1-based rank of each row inside its ``by`` group in ``order``; with
    ``count_out`` also the group size.  Exact and skew-proof (see module doc).

    Plan: one range exchange on (by, order), a sort inside each partition,
    and a per-row position taken from ``monotonically_increasing_id`` (the
    partition id in the high bits, the row's place in the sorted partition in
    the low bits; reproducible because the partition content and its sort
    are).  The per-(partition, group) first position and count form a table
    of at most #partitions + #groups rows, which supplies the offsets.
    ``order`` must make rows unique within a group.  The positioned rows are
    checkpointed once (``materialize``) so the statistics and the numbering
    read one partitioning.
    """
    keys = _keys(by)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kcols = [F.col(k) for k in keys]
    parted = (df.repartitionByRange(n, *kcols, *ocols)
              .sortWithinPartitions(*kcols, *ocols)
              .withColumn("_pos", F.monotonically_increasing_id())
              .withColumn("_pid", F.spark_partition_id()))
    # Both consumers below must see the same partition ids and positions.
    parted = materialize(parted)
    stats = parted.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"),
                                              F.min("_pos").alias("_first"))
    wg = Window.partitionBy(*keys).orderBy("_pid")
    offs = stats.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(wg.rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    if count_out:
        offs = offs.withColumn(count_out, F.sum("_cnt").over(Window.partitionBy(*keys)))
    keep = ["_pid", *keys, "_off", "_first"] + ([count_out] if count_out else [])
    from quarry.operators.indexing import join_null_safe
    res = join_null_safe(parted, offs.select(*keep), ["_pid", *keys])
    rank = F.col("_off") + (F.col("_pos") - F.col("_first")) + 1
    return res.withColumn(out, rank.cast("long")).drop("_pid", "_pos", "_off", "_first")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """AGG-23: rows per class and the smallest class count on every row."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("min_count", F.min("n").over(Window.partitionBy()))


def balance(df: DataFrame, label: str, id_col: str, seed: int = 42,
            within=None, cap: int | None = None) -> DataFrame:
    """WIN-3 / WIN-5: down-sample every class to the smallest class count.

    With ``within`` (e.g. the cluster) the smallest count is taken inside each
    outer group, and ``cap`` bounds it (``min(cap, smallest)``).  Rows are
    chosen in seeded hash order.
    """
    outer = _keys(within)
    grp = outer + [label]
    sizes = df.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"))
    target = sizes.groupBy(*outer).agg(F.min("_n").alias("_k")) if outer else \
        sizes.agg(F.min("_n").alias("_k"))
    if cap is not None:
        target = target.withColumn("_k", F.least(F.col("_k"), F.lit(cap)))
    ranked = group_rank(df.withColumn("_h", hash_order(id_col, seed)), grp, ["_h"], "_rn")
    if outer:
        from quarry.operators.indexing import join_null_safe
        ranked = join_null_safe(ranked, target, outer)
    else:
        ranked = ranked.crossJoin(F.broadcast(target))  # one row
    return ranked.filter(F.col("_rn") <= F.col("_k")).drop("_h", "_rn", "_k")


def diversity_sample(df: DataFrame, by, length: str, seq: str, m: int) -> DataFrame:
    """WIN-6: per group, sort by (length, seq) and keep every
    ``max(1, n // m)``-th row starting with the first, at most ``m`` rows."""
    r = group_rank(df, by, [length, seq], "_rn", "_n")
    interval = F.greatest(F.floor(F.col("_n") / m), F.lit(1))
    pos = F.col("_rn") - 1
    keep = ((pos % interval) == 0) & (F.floor(pos / interval) < m)
    return r.filter(keep).drop("_rn", "_n")


def stratified_split(df: DataFrame, by, id_col: str, seed: int = 42,
                     test: float = 0.1, val: float = 0.1111, out: str = "split") -> DataFrame:
    """WIN-7: per stratum in hash order, the first ``floor(test n)`` rows are
    ``test``, the next ``floor(val (n - n_test))`` ``val``, the rest ``train``."""
    r = group_rank(df.withColumn("_h", hash_order(id_col, seed)), by, ["_h"], "_rn", "_n")
    n_test = F.floor(F.col("_n") * F.lit(test))
    n_val = F.floor((F.col("_n") - n_test) * F.lit(val))
    split = (F.when(F.col("_rn") <= n_test, "test")
             .when(F.col("_rn") <= n_test + n_val, "val").otherwise("train"))
    return r.withColumn(out, split).drop("_h", "_rn", "_n")


def leading_split(df: DataFrame, id_col: str, seed: int = 42, frac: float = 0.1,
                  out: str = "split") -> DataFrame:
    """WIN-8: the first ``floor(frac n)`` rows in hash order are ``val``."""
    return stratified_split(df.withColumn("_all", F.lit(0)), "_all", id_col, seed,
                            test=0.0, val=frac, out=out).drop("_all")


def holdout(df: DataFrame, by, id_col: str, seed: int = 42, ratio: float = 0.2,
            out: str = "split") -> DataFrame:
    """WIN-9: per group the last ``max(1, floor(ratio n))`` rows in hash order
    are ``val``, the others ``train``."""
    r = group_rank(df.withColumn("_h", hash_order(id_col, seed)), by, ["_h"], "_rn", "_n")
    n_val = F.greatest(F.floor(F.col("_n") * F.lit(ratio)), F.lit(1))
    return r.withColumn(out, F.when(F.col("_rn") > F.col("_n") - n_val, "val")
                        .otherwise("train")).drop("_h", "_rn", "_n")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 123) -> DataFrame:
    """SRT-3 / SRT-4: the first ``n`` rows in seeded hash order (a top-k:
    each partition keeps ``n`` candidates, one merge)."""
    return df.withColumn("_h", hash_order(id_col, seed)).orderBy("_h").limit(n).drop("_h")


def mix(id_side: DataFrame, ood_side: DataFrame, id_col: str, n_each: int,
        seed: int = 42, out: str = "mix_pos") -> DataFrame:
    """SET-2: ``n_each`` rows of each side by seeded order, unioned, then put
    in a seeded shuffled order (``out`` = 0-based position)."""
    a = seeded_sample(id_side, id_col, n_each, seed).withColumn("side", F.lit("id"))
    b = seeded_sample(ood_side, id_col, n_each, seed).withColumn("side", F.lit("ood"))
    u = a.unionByName(b)
    from quarry.operators.indexing import dense_index
    u = u.withColumn("_h", hash_order(F.concat(F.col("side"), F.lit(":"),
                                               F.col(id_col).cast("string")), seed + 1))
    return dense_index(u, ["_h"], out).drop("_h")


def top_runs(runs: DataFrame, by, k: int = 3, acc: str = "val_acc",
             loss: str = "val_loss", tie: str | None = None) -> DataFrame:
    """SRT-1: best ``k`` runs per group by (accuracy desc, loss asc), then by
    ``tie``."""
    return capped_rank(runs, by, [F.col(acc).desc(), F.col(loss).asc(), *([tie] if tie else [])], k, "rank")


def first_runs(runs: DataFrame, order, k: int) -> DataFrame:
    """SRT-2: the first ``k`` runs in ``order`` (a top-k: every partition keeps
    k, one merge)."""
    return runs.orderBy(*order).limit(k)
