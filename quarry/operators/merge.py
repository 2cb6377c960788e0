"""Merge similar clusters inside a bucket (CLU-6, JOIN-5, JOIN-13).

Candidate pairs are clusters of one bucket whose centroids reach the cosine
cut (tile blocks, ``similarity_edges``); merging follows the connected
components of those pairs, so chains resolve to their root, the smallest
cluster id, and every source cluster moves exactly once.  Only buckets with
at least ``min_clusters`` clusters merge.  Centroids are recomputed from
the members of the merged cluster and keyword sets are unioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.centroids import centroids
from quarry.operators.graph import components, similarity_edges
from quarry.operators.indexing import dense_index


def merge_similar(clusters: DataFrame, members: DataFrame, by: str = "bucket",
                  cluster_id: str = "cluster_id", vec: str = "embedding",
                  centroid: str = "centroid", threshold: float = 0.8,
                  min_clusters: int = 3) -> tuple[DataFrame, DataFrame]:
    """Returns (mapping (by, cluster_id, target_id), merged clusters
    (by, cluster_id, centroid, n)).  ``members`` carries (by, cluster_id, vec)."""
    ids = dense_index(clusters.select(by, cluster_id, centroid), [by, cluster_id], "_gid")
    sizes = ids.groupBy(by).agg(F.count(F.lit(1)).alias("_k"))
    eligible = ids.join(sizes.filter(F.col("_k") >= min_clusters).select(by), by, "left_semi")
    edges = similarity_edges(eligible, "_gid", centroid, threshold, by=by, forest=True)
    comp = components(ids.select(F.col("_gid").alias("id")), edges, "id", "src", "dst")
    root = ids.select(F.col("_gid").alias("comp"), F.col(cluster_id).alias("target_id"))
    mapping = (ids.join(comp.withColumnRenamed("id", "_gid"), "_gid")
               .join(root, "comp")
               .select(by, cluster_id, "target_id"))
    moved = members.join(mapping, [by, cluster_id], "inner")
    merged = centroids(moved, [by, "target_id"], vec).withColumnRenamed("target_id", cluster_id)
    return mapping, merged


def union_keywords(words: DataFrame, mapping: DataFrame, by: str = "bucket",
                   cluster_id: str = "cluster_id") -> DataFrame:
    """Keyword rows (by, cluster_id, word) of merged clusters, deduplicated."""
    return (words.join(mapping, [by, cluster_id], "inner")
            .select(by, F.col("target_id").alias(cluster_id), "word").distinct())
