"""Parameter sweeps and score distributions (JOIN-9, JOIN-10, AGG-25, AGG-26,
WIN-13, WIN-15, FN-26).

The trigger components do not depend on the threshold or the weights, so the
rows are scored once.  Instead of joining every row to the grid (rows x grid
rows through the shuffle), each row carries a vector of 0/1 trigger
indicators, one per grid point, and ``Summarizer.sum`` adds the vectors per
true label with a map-side partial buffer: one pass, two output rows, then
arithmetic on at most grid-size rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.centroids import vector_sum
from quarry.operators.indexing import join_null_safe, running_total
from quarry.operators.quantiles import exact_quantiles
from quarry.operators.trigger import raw_score


def threshold_grid(n: int = 100) -> list[float]:
    """FN-26: i / n for i = 1..n."""
    return [i / n for i in range(1, n + 1)]


def linspace(start: float, stop: float, num: int) -> list[float]:
    """FN-26: numpy's ``linspace`` values."""
    return [float(x) for x in np.linspace(start, stop, num)]


def geomspace(start: float, stop: float, num: int) -> list[float]:
    """FN-26: numpy's ``geomspace`` values."""
    return [float(x) for x in np.geomspace(start, stop, num)]


def weight_grid(n: int = 8, top: float = 0.33) -> list[tuple[float, float, int, int]]:
    """JOIN-10 grid: (bleu/rouge weight, similarity weight, i, j) with the
    constraint sim <= 1 - 2 br (it never binds for top = 0.33)."""
    br = linspace(0.0, top, n)
    sim = linspace(0.0, top, n)
    return [(b, s, i, j) for i, b in enumerate(br) for j, s in enumerate(sim) if s <= 1.0 - 2 * b]


def _counts_from_indicators(df: DataFrame, label: str, ind: Column, size: int) -> DataFrame:
    """(i, tp, fp, fn, tn) for every grid index i from indicator vectors."""
    y = F.col(label).cast("int") == 1
    agg = (df.filter(F.col(label).isNotNull())
           .groupBy(y.alias("_pos"))
           .agg(vector_sum(ind).alias("_v"), F.count(F.lit(1)).alias("_n")))
    ex = agg.select("_pos", "_n", F.posexplode("_v").alias("i", "c"))
    per = ex.groupBy("i").agg(
        F.sum(F.when(F.col("_pos"), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("_pos"), F.col("c")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_pos"), F.col("_n")).otherwise(0)).alias("P"),
        F.sum(F.when(~F.col("_pos"), F.col("_n")).otherwise(0)).alias("N"))
    tp, fp = F.col("tp").cast("long"), F.col("fp").cast("long")
    fn = (F.col("P") - F.col("tp")).cast("long")
    tn = (F.col("N") - F.col("fp")).cast("long")
    n = F.col("P") + F.col("N")

    def ratio(a, b):
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    return per.select(
        "i", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        ratio(tp + tn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def sweep_threshold(scored: DataFrame, label: str, score: str = "anomaly_score",
                    grid: list[float] | None = None) -> DataFrame:
    """JOIN-9 + AGG-2: metrics at every threshold (trigger = score >= t)."""
    grid = grid or threshold_grid()
    g = F.array(*[F.lit(float(t)) for t in grid])
    ind = F.transform(g, lambda t: F.when(F.col(score) >= t, F.lit(1.0)).otherwise(F.lit(0.0)))
    c = _counts_from_indicators(scored, label, ind, len(grid))
    return c.withColumn("threshold", g[F.col("i")]).drop("i")


def sweep_weights(scored: DataFrame, label: str, threshold: float, max_margin: float,
                  grid=None, margin="margin", bleu="bleu", rouge="rouge",
                  similarity="similarity", band: DataFrame | None = None) -> DataFrame:
    """JOIN-10: F1 / accuracy per weight pair; margin weight = 1 - 2 br - sim.
    ``band`` (one row) halves scores strictly inside it, as in scoring."""
    grid = grid or weight_grid()
    src = scored
    inside = F.lit(False)
    if band is not None:
        src = src.crossJoin(F.broadcast(band.select("band_lo", "band_hi")))  # one row
        inside = (F.col(similarity) > F.col("band_lo")) & (F.col(similarity) < F.col("band_hi"))
    inds = []
    for br, sim, _, _ in grid:
        w = {"margin": 1.0 - 2 * br - sim, "bleu": br, "rouge": br, "similarity": sim}
        s = raw_score(F.col(margin), F.col(bleu), F.col(rouge), F.col(similarity), w, max_margin)
        s = F.when(inside, s * F.lit(0.5)).otherwise(s)
        inds.append(F.when(s >= F.lit(float(threshold)), F.lit(1.0)).otherwise(F.lit(0.0)))
    c = _counts_from_indicators(src, label, F.array(*inds), len(grid))
    meta = F.array(*[F.struct(F.lit(b).alias("br"), F.lit(s).alias("sim"),
                              F.lit(i).alias("br_idx"), F.lit(j).alias("sim_idx"))
                     for b, s, i, j in grid])
    m = meta[F.col("i")]
    return c.select(m["br"].alias("w_bleu_rouge"), m["sim"].alias("w_similarity"),
                    (F.lit(1.0) - 2 * m["br"] - m["sim"]).alias("w_margin"),
                    m["br_idx"].alias("br_idx"), m["sim_idx"].alias("sim_idx"),
                    "f1", "accuracy")


def sweep_matrix(sweep: DataFrame, value: str = "f1", n: int = 8) -> DataFrame:
    """AGG-26: one row per bleu/rouge weight index, one column per
    similarity weight index (``s0 .. s{n-1}``)."""
    p = sweep.groupBy("br_idx").pivot("sim_idx", list(range(n))).agg(F.first(value))
    return p.select("br_idx", *[F.col(str(j)).alias(f"s{j}") for j in range(n)])


def best_threshold(sweep: DataFrame, robust: float = 0.97) -> DataFrame:
    """WIN-15: the threshold with the first (smallest-threshold) maximum F1,
    and the robust range [min, max] of thresholds with F1 >= robust x max."""
    mx = sweep.agg(F.max("f1").alias("max_f1"))
    j = sweep.crossJoin(F.broadcast(mx))  # one row
    return j.agg(
        F.first("max_f1").alias("max_f1"),
        F.min(F.when(F.col("f1") == F.col("max_f1"), F.col("threshold"))).alias("best_threshold"),
        F.min(F.when(F.col("f1") >= F.lit(robust) * F.col("max_f1"), F.col("threshold")))
        .alias("robust_start"),
        F.max(F.when(F.col("f1") >= F.lit(robust) * F.col("max_f1"), F.col("threshold")))
        .alias("robust_end"))


def roc_curve(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """WIN-13: one ROC point per distinct score (descending), with tpr/fpr
    from a distributed running total (no global single-task window)."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    y = F.col(label).cast("int") == 1
    g = (df.filter(F.col(label).isNotNull())
         .groupBy(*keys, F.col(score).alias("thr"))
         .agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n")))
    tot = g.groupBy(*keys).agg(F.sum("p").alias("_tot_p"), F.sum("n").alias("_tot_n"))
    cum = running_total(g, [F.col("thr").desc()], ["p", "n"], by=keys)
    cum = join_null_safe(cum, tot, keys) if keys else cum.crossJoin(F.broadcast(tot))  # 1 row
    tp, tn = F.col("_tot_p"), F.col("_tot_n")
    return cum.select(*keys, "thr",
                      F.when(tp > 0, F.col("cum_p") / tp).otherwise(0.0).alias("tpr"),
                      F.when(tn > 0, F.col("cum_n") / tn).otherwise(0.0).alias("fpr"))


def auc(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """WIN-13: area under the ROC curve (trapezoids, ties as diagonal
    segments) = sum_s p_s (N_below(s) + n_s / 2) / (P N)."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    y = F.col(label).cast("int") == 1
    g = (df.filter(F.col(label).isNotNull())
         .groupBy(*keys, F.col(score).alias("thr"))
         .agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n")))
    cum = running_total(g, ["thr"], ["n"], by=keys)
    part = F.col("p") * (F.col("cum_n") - F.col("n") + F.col("n") * 0.5)
    a = cum.groupBy(*keys).agg(F.sum(part).alias("_u"), F.sum("p").alias("_tot_p"),
                               F.sum("n").alias("_tot_n"), F.count(F.lit(1)).alias("n_points"))
    tp, tn = F.col("_tot_p"), F.col("_tot_n")
    return a.select(*keys, F.when((tp > 0) & (tn > 0), F.col("_u") / (tp * tn)).alias("auc"),
                    "n_points")


def score_distribution(df: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """AGG-25: per (metric, group): quartiles, 1.5 IQR whiskers (the most
    extreme data inside the fences) and the outlier count."""
    long = df.select(by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score"))
        for m in metrics])).alias("x")).select(by, "x.metric", "x.score")
    q = exact_quantiles(long, "score", [0.25, 0.5, 0.75], by=["metric", by],
                        names=["q1", "median", "q3"])
    j = long.join(q, ["metric", by], "inner")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy("metric", by, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("score") >= lo_f, F.col("score"))).alias("whisker_low"),
        F.max(F.when(F.col("score") <= hi_f, F.col("score"))).alias("whisker_high"),
        F.count_if((F.col("score") < lo_f) | (F.col("score") > hi_f)).alias("n_outliers"))
