"""Evaluation aggregates (AGG-1..6, AGG-27, WIN-13).

Everything is a conditional aggregation: one pass, map-side partial sums,
one small shuffle on the grouping key (or none for a global row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _ratio(num: Column, den: Column) -> Column:
    """``zero_division = 0``."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def binary_counts(df: DataFrame, label: str, pred: str, by=None) -> DataFrame:
    """Confusion cells with the positive class 1 / true."""
    y = F.col(label).cast("int") == 1
    p = F.col(pred).cast("int") == 1
    return df.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def binary_metrics(df: DataFrame, label: str, pred: str, by=None) -> DataFrame:
    """AGG-1 + AGG-2: tp/fp/fn/tn, trigger rate, accuracy, precision,
    recall, F1 (all ``zero_division = 0``).  Rows with a null label are
    excluded (FLT-13)."""
    c = binary_counts(df.filter(F.col(label).isNotNull()), label, pred, by)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select(
        *_keys(by), "n", "tp", "fp", "fn", "tn",
        _ratio(tp + fp, n).alias("trigger_rate"),
        _ratio(tp + tn, n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_report(df: DataFrame, label: str, pred: str, by=None) -> DataFrame:
    """AGG-3 / AGG-4: per-class precision / recall / F1 / support plus the
    ``accuracy``, ``macro avg`` and ``weighted avg`` rows.

    Works from the (true, pred) contingency only: one aggregation over the
    data, then arithmetic on a table with at most k^2 rows per group.
    Labels are compared as strings, so any label type works.
    """
    keys = _keys(by)
    t = F.col(label).cast("string")
    p = F.col(pred).cast("string")
    base = df.select(*keys, t.alias("_t"), p.alias("_p"))
    cont = base.groupBy(*keys, "_t", "_p").agg(F.count(F.lit(1)).alias("_c"))
    # per class: support (true count), predicted count, true positives
    sup = cont.groupBy(*keys, F.col("_t").alias("cls")).agg(
        F.sum("_c").alias("support"),
        F.sum(F.when(F.col("_t") == F.col("_p"), F.col("_c")).otherwise(0)).alias("tp"))
    prd = cont.groupBy(*keys, F.col("_p").alias("cls")).agg(F.sum("_c").alias("predicted"))
    per = (sup.join(prd, keys + ["cls"], "full_outer")
           .select(*keys, "cls",
                   F.coalesce("support", F.lit(0)).cast("long").alias("support"),
                   F.coalesce("predicted", F.lit(0)).cast("long").alias("predicted"),
                   F.coalesce("tp", F.lit(0)).cast("long").alias("tp")))
    prec = _ratio(F.col("tp"), F.col("predicted"))
    rec = _ratio(F.col("tp"), F.col("support"))
    per = per.select(*keys, "cls", "support", "tp",
                     prec.alias("precision"), rec.alias("recall"))
    per = per.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")))
    # Classes are the union of true and predicted labels (a class that is
    # only predicted has support 0), as in sklearn's report.
    tot = per.groupBy(*keys).agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_tp"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"))
    n = F.col("_n")
    acc = tot.select(*keys, F.lit("accuracy").alias("cls"), n.cast("long").alias("support"),
                     _ratio(F.col("_tp"), n).alias("precision"),
                     _ratio(F.col("_tp"), n).alias("recall"),
                     _ratio(F.col("_tp"), n).alias("f1"))
    macro = tot.select(*keys, F.lit("macro avg").alias("cls"), n.cast("long").alias("support"),
                       F.col("_mp").alias("precision"), F.col("_mr").alias("recall"),
                       F.col("_mf").alias("f1"))
    weighted = tot.select(*keys, F.lit("weighted avg").alias("cls"),
                          n.cast("long").alias("support"),
                          _ratio(F.col("_wp"), n).alias("precision"),
                          _ratio(F.col("_wr"), n).alias("recall"),
                          _ratio(F.col("_wf"), n).alias("f1"))
    cols = keys + ["cls", "support", "precision", "recall", "f1"]
    return (per.select(*cols).unionByName(acc.select(*cols))
            .unionByName(macro.select(*cols)).unionByName(weighted.select(*cols)))


def numeric_metrics(df: DataFrame, label: str, pred: str, by=None) -> DataFrame:
    """AGG-5 / AGG-6 / FLT-9: exact match, MAE, MSE over rows where both
    the prediction and the label parsed; ``total_samples`` counts all rows and
    ``numeric_extraction_rate`` = valid / total.  Empty -> null metrics."""
    ok = F.col(pred).isNotNull() & F.col(label).isNotNull()
    err = F.col(pred).cast("double") - F.col(label).cast("double")
    return df.groupBy(*_keys(by)).agg(
        F.avg(F.when(ok, (err == 0).cast("double"))).alias("exact_match"),
        F.avg(F.when(ok, F.abs(err))).alias("mae"),
        F.avg(F.when(ok, err * err)).alias("mse"),
        F.count_if(ok).alias("valid_predictions"),
        F.count(F.lit(1)).alias("total_samples"),
    ).withColumn("numeric_extraction_rate",
                 _ratio(F.col("valid_predictions"), F.col("total_samples")))


def containment_accuracy(df: DataFrame, gold: str, pred: str, by=None) -> DataFrame:
    """AGG-27 / FN-17: percent of rows whose lower-cased gold text occurs in
    the lower-cased prediction."""
    hit = F.lower(F.col(pred)).contains(F.lower(F.col(gold)))
    return df.groupBy(*_keys(by)).agg(
        (F.avg(hit.cast("double")) * 100.0).alias("containment_accuracy"),
        F.count(F.lit(1)).alias("n"))


def roc_points(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """WIN-13: ROC points; see ``sweeps.roc_curve`` (distributed running
    totals, no single-task window)."""
    from quarry.operators.sweeps import roc_curve
    return roc_curve(df, label, score, by)


def roc_auc(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """WIN-13: trapezoid AUC; see ``sweeps.auc``."""
    from quarry.operators.sweeps import auc
    return auc(df, label, score, by)
