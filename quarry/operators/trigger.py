"""Trigger scoring (FN-9, FN-29, AGG-7, JOIN-11, FLT-5, FLT-12, WIN-1, UDX-2).

score = w_m (1 - margin / max_margin) + w_b (1 - bleu) + w_r (1 - rouge)
        + w_s (1 - similarity)
halved when the similarity lies strictly inside the in-distribution band,
triggered when score >= threshold.  A blank gold answer sets
bleu = rouge = similarity = 1 (only the margin term is live).

The components never depend on the weights or the threshold, so sweeps score
once and join a parameter grid (see ``sweeps``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip

# The reference defaults.
DEFAULT_WEIGHTS = {"margin": 0.33, "bleu": 0.12, "rouge": 0.23, "similarity": 0.33}
DEFAULT_MAX_MARGIN = 5.0
DEFAULT_THRESHOLD = 0.5
DEFAULT_EMA_ALPHA = 0.1
DEFAULT_BAND_PCT = (0.05, 0.95)


def fit_band(df: DataFrame, col: str = "similarity", pct=DEFAULT_BAND_PCT,
             where: Column | None = None) -> DataFrame:
    """AGG-7: one-row ``(band_lo, band_hi)``, exact percentiles with linear
    interpolation (numpy's default), over the rows selected by ``where``.

    Uses the distributed exact quantile (no single-buffer ``percentile``);
    with no rows the band is null, so nothing is halved.
    """
    from quarry.operators.quantiles import exact_quantiles
    src = df.filter(where) if where is not None else df
    q = exact_quantiles(src, col, [float(pct[0]), float(pct[1])], names=["band_lo", "band_hi"])
    one = src.sparkSession.range(1).select(F.lit(1).alias("_one"))
    return one.join(q.withColumn("_one", F.lit(1)), "_one", "left").select("band_lo", "band_hi")


def raw_score(margin: Column, bleu: Column, rouge: Column, sim: Column,
              weights=None, max_margin: float = DEFAULT_MAX_MARGIN) -> Column:
    w = dict(DEFAULT_WEIGHTS, **(weights or {}))
    return (F.lit(w["margin"]) * (F.lit(1.0) - margin / F.lit(float(max_margin)))
            + F.lit(w["bleu"]) * (F.lit(1.0) - bleu)
            + F.lit(w["rouge"]) * (F.lit(1.0) - rouge)
            + F.lit(w["similarity"]) * (F.lit(1.0) - sim))


def score_anomaly(df: DataFrame, band: DataFrame | None = None, weights=None,
                  max_margin: float = DEFAULT_MAX_MARGIN,
                  threshold: float = DEFAULT_THRESHOLD,
                  margin: str = "margin", bleu: str = "bleu", rouge: str = "rouge",
                  similarity: str = "similarity", gold: str | None = None) -> DataFrame:
    """FN-9 / FN-29 / JOIN-11 / FLT-12.

    ``band`` is a one-row DataFrame (``fit_band``); it is broadcast, which is
    safe because a global aggregate has exactly one row.  With ``gold`` set,
    rows whose gold text is null or blank take bleu = rouge = similarity = 1.
    Adds ``anomaly_score`` and ``trigger``.
    """
    out = df
    if gold is not None:
        blank = F.col(gold).isNull() | (strip(gold) == "")
        for c in (bleu, rouge, similarity):
            out = out.withColumn(c, F.when(blank, F.lit(1.0)).otherwise(F.col(c)))
    s = raw_score(F.col(margin), F.col(bleu), F.col(rouge), F.col(similarity),
                  weights, max_margin)
    if band is not None:
        out = out.crossJoin(F.broadcast(band.select("band_lo", "band_hi")))  # one row
        inside = (F.col(similarity) > F.col("band_lo")) & (F.col(similarity) < F.col("band_hi"))
        s = F.when(inside, s * F.lit(0.5)).otherwise(s)
    out = out.withColumn("anomaly_score", s)
    out = out.withColumn("trigger", F.col("anomaly_score") >= F.lit(float(threshold)))
    if band is not None:
        out = out.drop("band_lo", "band_hi")
    return out


def keep_triggered(df: DataFrame, trigger: str = "trigger") -> DataFrame:
    """FLT-5: the rows that fire; a null trigger does not."""
    return df.where(F.col(trigger))


def ema(df: DataFrame, value: str, order, by=None, alpha: float = DEFAULT_EMA_ALPHA,
        out: str = "ema_score", chunk_rows: int = 100_000) -> DataFrame:
    """WIN-1: e_t = (1 - a) e_{t-1} + a x_t with e_0 = 0, per key in ``order``.

    A scan over chunks.  Rows get their exact rank within the key (distributed
    ``group_rank``) and the key's sequence is cut into chunks.  Inside a chunk
    the EMA that starts from 0 is a running sum of a x_j (1-a)^(i-j), with the
    powers taken from the chunk's start; a chunk is so short that they stay
    within 100 orders of magnitude.  What a chunk leaves behind obeys
    the same recurrence with the decay d = (1-a)^chunk, so the chunks' ends
    (one row each) go through this function again, and a row adds its carry
    times (1-a)^(i+1).  The decay shrinks with every level, which ends the
    levels.  Work is linear and a key with a third of all rows spreads over
    many tasks.  ``order`` must be unique within a key; a null value counts
    as 0.
    """
    from quarry.operators.indexing import join_null_safe
    from quarry.operators.sampling import group_rank
    from quarry.session import materialize
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    order = [order] if isinstance(order, str) else list(order)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    keep = 1.0 - float(alpha)
    if keep <= 0.0:  # no memory
        return df.withColumn(out, x)
    m = max(1, min(chunk_rows, int(100 / -math.log10(keep))))
    at = F.col("_rk") - 1
    r = group_rank(df, keys, order, "_rk").withColumns({
        "_chunk": F.floor(at / m).cast("long"), "_i": at % m})
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rk").rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(keep), F.col("_i"))
    local = r.withColumn("_local", power * F.sum(x * float(alpha) / power).over(w))
    d = keep ** m
    ends = (local.where(F.col("_i") == m - 1)
            .select(*keys, F.col("_chunk").alias("_nth"), (F.col("_local") / (1.0 - d)).alias("_end")))
    ends = ema(materialize(ends), "_end", "_nth", keys, 1.0 - d, "_left", chunk_rows)
    carries = ends.select(*keys, (F.col("_nth") + 1).alias("_chunk"), F.col("_left").alias("_carry"))
    joined = join_null_safe(local, carries, [*keys, "_chunk"], "left")
    e = F.col("_local") + F.coalesce("_carry", F.lit(0.0)) * power * keep
    return joined.withColumn(out, e).drop("_rk", "_chunk", "_i", "_local", "_carry")
