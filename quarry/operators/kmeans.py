"""K-means (CLU-1).

``kmeans`` is MLlib's distributed KMeans (k-means|| initialisation).
``kmeans_step`` is one Lloyd iteration against given centroids: the
assignment (nearest centroid, squared Euclidean, ties to the smallest id) and
the update (mean of the assigned rows), both DataFrame operations.
``lloyd`` repeats it from hash-ordered seeds, so a run can be repeated and
replayed in SQL; its centroids (k rows) are written once a round.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import sq_euclidean
from quarry.operators.centroids import assign_to_centroids, centroids
from quarry.operators.sampling import hash_order
from quarry.session import materialize


def seeded_centroids(df: DataFrame, id_col: str, vec: str, k: int, seed: int = 42) -> DataFrame:
    """k initial centroids: the first k rows in seeded hash order, numbered
    0..k-1 in that order (a k-row table)."""
    top = df.select(id_col, vec, hash_order(id_col, seed).alias("_h")).orderBy("_h").limit(k)
    return top.select((F.row_number().over(Window.orderBy("_h")) - 1).alias("cluster_id"),
                      F.col(vec).cast("array<double>").alias("centroid"))


def kmeans_step(df: DataFrame, cents: DataFrame, vec: str = "embedding"):
    """Returns (assigned rows with ``cluster`` and ``sq_dist``, new centroids)."""
    a = assign_to_centroids(df, cents, vec, "cluster_id", "centroid", "sqeuclidean", "cluster")
    a = a.join(cents.select(F.col("cluster_id").alias("cluster"), F.col("centroid").alias("_c")),
               "cluster").withColumn("sq_dist", sq_euclidean(vec, "_c")).drop("_c")
    new = centroids(a, "cluster", vec).withColumnRenamed("cluster", "cluster_id")
    return a, new


def lloyd(df: DataFrame, cents: DataFrame, vec: str = "embedding", rounds: int = 10, tol: float = 0.0):
    """At most ``rounds`` Lloyd rounds from ``cents``; returns (rows with
    ``cluster`` and ``sq_dist`` to the last centroids, the last centroids).  It
    ends early when no centroid moves by more than ``tol``; a centroid that no row
    is nearest to goes."""
    cents = materialize(cents.select("cluster_id", "centroid"))
    for _ in range(rounds):
        _, new = kmeans_step(df, cents, vec)
        new = materialize(new.select("cluster_id", "centroid"))
        moved = new.join(cents.select("cluster_id", F.col("centroid").alias("_old")), "cluster_id").agg(
            F.max(sq_euclidean("centroid", "_old"))).first()[0]
        cents = new
        if moved is None or moved <= tol * tol:
            break
    return kmeans_step(df, cents, vec)[0], cents


def kmeans(df: DataFrame, vec: str = "embedding", k: int = 5, seed: int = 42,
           max_iter: int = 20, out: str = "cluster"):
    """MLlib KMeans on an array column; returns (rows with ``out``, model)."""
    x = df.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol=out).fit(x)
    return model.transform(x).drop("_features"), model
