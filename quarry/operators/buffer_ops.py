"""Cluster-buffer utilities as DataFrame operators (AGG-8, JOIN-12, AGG-28,
AGG-30, WIN-10, FN-10..14, PRJ-9, AGG-24, SNK-3/5/6).

These are the reusable forms of steps the query plans use: seeded pair
sampling and the automatic similarity threshold, the cluster integrity
check, count windows, a dispatcher over the numeric-answer rules, the
overlap report, section parsing and metric sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vectors import cosine
from quarry.operators.centroids import centroids
from quarry.operators.indexing import dense_index
from quarry.operators.quantiles import exact_quantiles


def sample_pairs(df: DataFrame, id_col: str, vec: str, max_pairs: int = 1000,
                 seed: int = 42) -> DataFrame:
    """JOIN-12: exactly min(``max_pairs``, n(n-1)/2) distinct pairs i < j,
    never listing all pairs; returns (i, j, cos).  The pair numbers
    0..n(n-1)/2-1 (pair (i, j) has number j(j-1)/2 + i) are cut into that many
    even strata and a seeded hash draws one number in each, so no draw repeats
    another.  The sample size is the feature."""
    spark = df.sparkSession
    e = dense_index(df.select(id_col, vec), id_col, "_i")
    n = e.agg(F.count(F.lit(1)).alias("n"))  # one row

    def below(j):  # pairs whose larger index is below j
        return F.expr(f"({j} * ({j} - 1)) div 2")

    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string"))), 1, 15),
               16, 10).cast("long")
    total = n.select(F.expr("n * (n - 1) div 2").alias("pairs")) \
             .withColumn("m", F.least("pairs", F.lit(max_pairs)).cast("long"))
    strata = (spark.range(max_pairs).withColumnRenamed("id", "k")
              .join(F.broadcast(total), F.col("k") < F.col("m"))  # one row
              .select("k", F.expr("pairs div greatest(m, 1)").alias("width"),
                      F.expr("pairs % greatest(m, 1)").alias("rest")))
    start = F.col("k") * F.col("width") + F.least("k", "rest")
    size = F.col("width") + F.when(F.col("k") < F.col("rest"), 1).otherwise(0)
    p = strata.select((start + F.pmod(h, F.greatest(size, F.lit(1)))).alias("p"))
    root = F.floor((1 + F.sqrt(1 + 8.0 * F.col("p"))) / 2)  # off by one at most for large numbers
    p = p.withColumn("r", root.cast("long")).withColumn("s", F.col("r") + 1)
    j = F.when(below("r") > F.col("p"), F.col("r") - 1).when(below("s") <= F.col("p"), F.col("s")).otherwise(F.col("r"))
    draws = p.withColumn("j", j).select((F.col("p") - below("j")).alias("i"), "j")
    a = e.select(F.col("_i").alias("i"), F.col(vec).alias("va"))
    b = e.select(F.col("_i").alias("j"), F.col(vec).alias("vb"))
    return draws.join(a, "i").join(b, "j").select("i", "j", cosine("va", "vb").alias("cos"))


def auto_threshold(df: DataFrame, id_col: str, vec: str, max_pairs: int = 1000,
                   pct: float = 0.3, seed: int = 42, default: float = 0.45) -> DataFrame:
    """AGG-8: the ``pct`` quantile of sampled pair cosines (one row:
    n_pairs, similarity_threshold); fewer than two pairs -> ``default``."""
    p = sample_pairs(df, id_col, vec, max_pairs, seed)
    q = exact_quantiles(p, "cos", [pct], names=["_q"])
    one = df.sparkSession.range(1).select(F.lit(1).alias("_k"))
    j = one.join(q.withColumn("_k", F.lit(1)), "_k", "left")
    return j.select(F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_pairs"),
                    F.when(F.col("n") >= 2, F.col("_q")).otherwise(F.lit(default))
                    .alias("similarity_threshold"))


def check_integrity(members: DataFrame, clusters: DataFrame, by: str = "bucket",
                    cluster_id: str = "cluster_id") -> DataFrame:
    """AGG-28 / AGG-30: per bucket, members, members whose cluster is not in
    the cluster table (anti join) and the number of live clusters used."""
    cl = clusters.select(by, cluster_id).distinct()
    orphans = (members.join(cl, [by, cluster_id], "left_anti")
               .groupBy(by).agg(F.count(F.lit(1)).alias("orphan_members")))
    live = (members.join(cl, [by, cluster_id], "left_semi")
            .groupBy(by).agg(F.countDistinct(cluster_id).alias("clusters")))
    tot = members.groupBy(by).agg(F.count(F.lit(1)).alias("members"))
    return (tot.join(orphans, by, "left").join(live, by, "left")
            .select(by, "members",
                    F.coalesce("orphan_members", F.lit(0)).alias("orphan_members"),
                    F.coalesce("clusters", F.lit(0)).alias("clusters")))


def buffer_integrity(members: DataFrame, clusters: DataFrame, centroids_: DataFrame, keyword_sets: DataFrame,
                     by: str = "bucket", cluster_id: str = "cluster_id") -> DataFrame:
    """AGG-28: per bucket, the mapped ids, those without a cluster row, and how
    many cluster ids, centroids and keyword sets there are; ``sound`` if no id is
    an orphan and the three counts agree."""
    keys = [by, cluster_id]
    marked = [(clusters, "c"), (centroids_, "v"), (keyword_sets, "k")]
    rows = members.select(*keys).distinct().withColumn("what", F.lit("m"))
    for df, what in marked:
        rows = rows.unionByName(df.select(*keys).distinct().withColumn("what", F.lit(what)))
    per = rows.groupBy(*keys).agg(*[F.count_if(F.col("what") == w).alias(w) for w in "mcvk"])
    out = per.groupBy(by).agg(F.sum("m").alias("mapped"), F.count_if((F.col("m") > 0) & (F.col("c") == 0)).alias("orphan_ids"),
                              F.sum("c").alias("cluster_ids"), F.sum("v").alias("centroids"), F.sum("k").alias("keyword_sets"))
    return out.withColumn("sound", (F.col("orphan_ids") == 0) & (F.col("cluster_ids") == F.col("centroids"))
                          & (F.col("cluster_ids") == F.col("keyword_sets")))


def with_cluster(members: DataFrame, clusters: DataFrame, by: str = "bucket", cluster_id: str = "cluster_id") -> DataFrame:
    """JOIN-2: each member with its cluster's row.  One row per cluster; Spark
    broadcasts the cluster side if it measures small, else splits hot clusters."""
    return members.join(clusters, [by, cluster_id])


def buffer_occupancy(members: DataFrame, by: str = "bucket", cluster_id: str = "cluster_id") -> DataFrame:
    """AGG-30: per bucket, the rows that wait in the buffer (cluster id -1 or
    null) and the rows that a cluster has."""
    waits = F.coalesce(F.col(cluster_id) == -1, F.lit(True))
    return members.groupBy(by).agg(F.count_if(waits).alias("buffered"), F.count_if(~waits).alias("assigned"))


def drop_noise(members: DataFrame, cluster_id: str = "cluster") -> DataFrame:
    """FLT-6: the rows that a cluster has (null and negative ids are noise)."""
    return members.where(F.col(cluster_id) >= 0)


def size_gate(clusters: DataFrame, least: int, size: str = "num_samples") -> DataFrame:
    """FLT-7: the clusters with at least ``least`` samples."""
    return clusters.where(F.col(size) >= least)


def pool_chunks(chunks: DataFrame, by, vec: str = "embedding") -> DataFrame:
    """FN-23: one vector per sample, the mean of its chunks' vectors, and the
    number of chunks.  Partial sums meet in one exchange."""
    return centroids(chunks, by, vec, out=vec, count="n_chunks")


def count_windows(df: DataFrame, order, size: int = 200, out: str = "window") -> DataFrame:
    """WIN-10: tumbling count windows of ``size`` rows in ``order``
    (distributed position, no global window)."""
    return (dense_index(df, order, "_pos")
            .withColumn(out, F.floor(F.col("_pos") / size).cast("long")).drop("_pos"))


def extract_number(text, rule: str = "final", label=None) -> Column:
    """FN-10..14 dispatcher: ``gold`` (#### n), ``final`` (final-answer rule
    with last-lines fallback), ``nearest`` (closest to ``label``),
    ``first_int`` or ``first_digit``."""
    if rule == "gold":
        return T.gold_number(text)
    if rule == "final":
        return T.final_answer_number(text)
    if rule == "nearest":
        if label is None:
            raise ValueError("the nearest rule needs the label")
        return T.nearest_number(text, label)
    if rule == "first_int":
        return T.first_int(text)
    if rule == "first_digit":
        return T.first_digit(text)
    raise ValueError(f"unknown rule {rule}")


#: Patterns of the prompt's sections (fixed values).
CONTEXT_SECTION = r"(?s)Context:(.*?)(?:\n\n|Options:)"
OPTIONS_SECTION = r"(?s)Options:\n(.*?)(?:\n\nAnswer:|\nAnswer:)"


def parse_sections(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """PRJ-9: ``Context:`` and ``Options:`` sections of a prompt."""
    return df.withColumns({"context": T.strip(F.regexp_extract(prompt, CONTEXT_SECTION, 1)),
                           "options": T.strip(F.regexp_extract(prompt, OPTIONS_SECTION, 1))})


def overlap_report(df: DataFrame, key: str, pred: str, gold: str, stem: bool = True) -> DataFrame:
    """AGG-24: mean ROUGE-L F (stemmed by default) and BLEU-4 over pairs."""
    from quarry.operators.overlap import score_pairs
    s = score_pairs(df, key, pred, gold, ("bleu4", "rougeL"), stem=stem)
    return s.agg(F.avg("rougeL").alias("avg_rougeL_f1"), F.avg("bleu4").alias("avg_bleu4"),
                  F.count(F.lit(1)).alias("n_pairs"))


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SNK-3 / SNK-5 / SNK-6: ``json`` document, ``csv`` with header, or
    ``log`` (append-only Parquet with the run time stamp)."""
    from quarry.sources import io as IO
    if fmt == "json":
        IO.write_json(df, path)
    elif fmt == "csv":
        IO.write_csv(df, path)
    elif fmt == "log":
        IO.append_metrics(df, path)
    else:
        raise ValueError(f"unknown format {fmt}")
