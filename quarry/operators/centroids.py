"""Cluster geometry: centroids, distances, nearest-centroid assignment.

AGG-9 centroid, AGG-10 intra distance, AGG-11 / JOIN-4 inter distance,
AGG-19 central similarity, JOIN-3 nearest cluster, JOIN-6 / AGG-21 drift.

Centroids use ``Summarizer.mean``: an imperative JVM aggregate with a
map-side partial buffer, so one shuffle of ``#partitions x #keys`` buffers and
no per-element explode.  Pairwise centroid statistics are computed from sums of
unit vectors and their outer products, which gives the exact mean and spread of
all ``i < j`` cosines without listing the pairs.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine, dot, norm, unit
from quarry.operators.indexing import join_null_safe


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def vector_mean(vec) -> "F.Column":
    """Component-wise mean of an ``array<double>`` column (an aggregate)."""
    c = F.col(vec) if isinstance(vec, str) else vec
    return vector_to_array(Summarizer.mean(array_to_vector(c.cast("array<double>"))))


def vector_sum(vec) -> "F.Column":
    c = F.col(vec) if isinstance(vec, str) else vec
    return vector_to_array(Summarizer.sum(array_to_vector(c.cast("array<double>"))))


def centroids(df: DataFrame, by, vec: str = "embedding", out: str = "centroid",
              count: str = "n") -> DataFrame:
    """AGG-9: one row per group with the mean vector and the member count."""
    keys = _keys(by)
    return (df.groupBy(*keys)
            .agg(vector_mean(vec).alias(out), F.count(F.lit(1)).alias(count)))


def with_centroid(df: DataFrame, cents: DataFrame, by, out: str = "centroid") -> DataFrame:
    """Attach each row's own group centroid (equi-join on the group key).

    The centroid table has one row per group; AQE broadcasts it once its
    measured size is under the adaptive threshold, otherwise the join stays a
    sort-merge join.  No hint is given because the group count is data.
    """
    keys = _keys(by)
    return df.join(cents.select(*keys, F.col(out)), keys, "inner")


def intra_distance(df: DataFrame, by, vec: str = "embedding", min_size: int = 2) -> DataFrame:
    """AGG-10 + FLT-11: mean cosine distance of members to their centroid.

    Groups below ``min_size`` members are skipped, as in the summary report.
    """
    keys = _keys(by)
    cents = centroids(df, keys, vec).filter(F.col("n") >= min_size)
    j = with_centroid(df, cents, keys)
    return (j.groupBy(*keys)
            .agg(F.avg(F.lit(1.0) - cosine(vec, "centroid")).alias("intra_distance"),
                 F.count(F.lit(1)).alias("n")))


def central_similarity(df: DataFrame, by, vec: str = "embedding",
                       group_by=None) -> DataFrame:
    """AGG-19: mean cosine of every member to its own centroid.

    ``group_by`` (a subset of ``by``, e.g. the method) keeps one row per
    outer group; without it the result is one row.
    """
    keys = _keys(by)
    outer = _keys(group_by)
    cents = centroids(df, keys, vec)
    j = with_centroid(df, cents, keys)
    return j.groupBy(*outer).agg(F.avg(cosine(vec, "centroid")).alias("central_similarity"))


def pairwise_cosine_stats(cents: DataFrame, vec: str = "centroid", by=None,
                          dim: int | None = None) -> DataFrame:
    """JOIN-4 / AGG-11 without the pair list.

    For unit vectors u_i: sum_{i<j} u_i.u_j = (|sum u|^2 - sum |u|^2) / 2 and
    sum_{i<j} (u_i.u_j)^2 = (||sum u u^T||_F^2 - sum |u|^4) / 2.  Both need
    only per-group vector sums, so the work is linear in the number of rows
    (d^2 per row for the second moment).  Returns the pair count, the mean and
    population std of the cosine distance, per ``by`` group.
    """
    keys = _keys(by)
    u = unit(vec)
    nz = F.when(norm(vec) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    outer = F.flatten(F.transform(u, lambda x: F.transform(u, lambda y: x * y)))
    agg = (cents.select(*keys, u.alias("_u"), nz.alias("_nz"), outer.alias("_o"))
           .groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n"),
                vector_sum("_u").alias("_s"),
                F.sum("_nz").alias("_q"),
                vector_sum("_o").alias("_g")))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s1 = (dot("_s", "_s") - F.col("_q")) / 2          # sum of cosines over pairs
    s2 = (dot("_g", "_g") - F.col("_q")) / 2          # sum of squared cosines
    mean_cos = s1 / pairs
    var = F.greatest(s2 / pairs - mean_cos * mean_cos, F.lit(0.0))
    return agg.select(
        *keys,
        pairs.cast("long").alias("n_pairs"),
        F.when(pairs > 0, F.lit(1.0) - mean_cos).alias("mean_distance"),
        F.when(pairs > 0, F.sqrt(var)).alias("std_distance"),
    )


def assign_nearest(samples: DataFrame, clusters: DataFrame, by: str = "bucket",
                   id_col: str = "sample_id", vec: str = "embedding", kw: str = "keywords",
                   w_cos: float = 0.7, w_kw: float = 0.3,
                   cluster_vec: str = "centroid", cluster_id: str = "cluster_id",
                   cluster_words: DataFrame | None = None, cluster_kw: str = "keywords",
                   threshold: float | None = None) -> DataFrame:
    """JOIN-3 + FN-20 + FN-21: best cluster of the sample's bucket.

    score = w_cos cos(v, centroid) + w_kw |K_s & K_c| / max(|K_c|, 1); the
    first maximum wins (ties go to the smallest cluster id).  Tiles of samples
    meet blocks of their bucket's clusters (``nearest``), so no row per sample
    and cluster exists.  ``cluster_words`` is the long table (by, cluster_id,
    word); otherwise ``cluster_kw`` arrays are exploded.  Returns (id, bucket,
    assigned_cluster, match_score) for every sample row: cluster and score are
    null where the sample has no bucket or vector or its bucket no cluster; with
    ``threshold`` the cluster is also null when the best score is below it.
    """
    from quarry.operators.nearest import assign, nearest_cluster
    from quarry.session import materialize
    if cluster_words is None:
        cluster_words = clusters.select(F.col(by), F.col(cluster_id), F.explode(F.array_distinct(cluster_kw)).alias("word"))
    rows = materialize(samples.select(F.col(id_col), F.col(by).alias("by"), F.col(vec).alias("vec"), F.col(kw).alias("words"),
                                      F.monotonically_increasing_id().alias("uid")))
    found = nearest_cluster(rows, clusters.select(F.col(by).alias("by"), F.col(cluster_id).alias("cid"), F.col(cluster_vec).alias("vec")),
                            cluster_words.select(F.col(by).alias("by"), F.col(cluster_id).alias("cid"), "word"), w_cos, w_kw)
    out = assign(rows.select(id_col, F.col("by").alias(by), "uid"), found, "assigned_cluster", "match_score").drop("uid")
    if threshold is not None:
        out = out.withColumn("assigned_cluster", F.when(F.col("match_score") >= threshold, F.col("assigned_cluster")))
    return out


def assign_to_centroids(df: DataFrame, cents: DataFrame, vec: str = "embedding",
                        cluster_id: str = "cluster_id", centroid: str = "centroid",
                        metric: str = "cosine", out: str = "pred",
                        most_bytes: int = 32 << 20) -> DataFrame:
    """Nearest of a *model's* k centroids (KMeans-style assignment step).

    The centroids are packed into one row and broadcast, and each row scans them
    with array functions in the JVM.  Their bytes are measured first: beyond
    ``most_bytes`` they are cut into blocks of that size, and each block takes
    one pass, which keeps a row's best so far.  Ties go to the smallest id.
    ``metric``: ``cosine`` (max similarity) or ``sqeuclidean`` (min distance).
    """
    from quarry.operators.indexing import running_total
    from quarry.session import materialize
    width = F.size(centroid) * 8 + 32
    total = cents.agg(F.sum(width.cast("long"))).first()[0] or 0
    blocks = [cents]
    if total > most_bytes:
        sized = running_total(cents.select(cluster_id, centroid, width.cast("long").alias("_b")), [cluster_id], ["_b"])
        sized = materialize(sized.withColumn("_blk", F.floor((F.col("cum__b") - F.col("_b")) / most_bytes)))
        blocks = [sized.where(F.col("_blk") == i) for i in range(sized.agg(F.max("_blk")).first()[0] + 1)]

    def near(c):  # the smallest pair is the best: (distance, id)
        far = (-cosine(vec, c["c"], "_vn", c["cn"]) if metric == "cosine" else
               F.aggregate(F.zip_with(F.col(vec), c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, y: acc + y))
        return F.struct(far.alias("far"), c["cid"].alias("cid"))

    j = df.withColumn("_vn", norm(vec))
    for i, block in enumerate(blocks):
        packed = block.agg(F.collect_list(F.struct(F.col(cluster_id).alias("cid"), F.col(centroid).alias("c"),
                                                   norm(centroid).alias("cn"))).alias("_cents"))
        j = j.crossJoin(F.broadcast(packed))  # one packed row
        best = F.array_min(F.transform("_cents", near))
        j = j.withColumn("_best", best if i == 0 else F.least(F.col("_best"), best)).drop("_cents")
        if len(blocks) > 1:
            j = materialize(j)
    return j.withColumn(out, F.col("_best.cid")).drop("_best", "_vn")


def best_match_similarity(curr: DataFrame, prev: DataFrame, vec: str = "centroid",
                          by=None, id_col: str = "cluster_id") -> DataFrame:
    """JOIN-6 / AGG-21: for each current centroid its max cosine to any
    previous centroid, then mean and population std per ``by`` group.

    Both sides are centroid tables (one row per cluster).  The comparison is
    an equi-join on ``by`` (window / bucket); the per-group candidate count is
    the number of previous clusters.
    """
    keys = _keys(by)
    p = prev.select(*keys, F.col(vec).alias("_pv"), norm(vec).alias("_pn"))
    c = curr.select(*keys, F.col(id_col), F.col(vec), norm(vec).alias("_cn"))
    if not keys:
        raise ValueError("best_match_similarity compares centroid sets per key (window/bucket)")
    j = c.join(p, keys, "inner")
    best = j.groupBy(*keys, id_col).agg(
        F.max(cosine(vec, "_pv", "_cn", "_pn")).alias("best_sim"))
    return best.groupBy(*keys).agg(F.avg("best_sim").alias("mean_center_sim"),
                                   F.stddev_pop("best_sim").alias("std_center_sim"))


def ordinal(df: DataFrame, by, order_col: str, out: str = "ordinal") -> DataFrame:
    """Position of a row inside its group (0-based), ordered by ``order_col``."""
    keys = _keys(by)
    w = Window.partitionBy(*keys).orderBy(order_col)
    return df.withColumn(out, F.row_number().over(w) - 1)
