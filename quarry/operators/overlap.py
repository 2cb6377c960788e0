"""Text overlap scores over a pair table (FN-5..8, AGG-24).

``score_pairs`` takes a DataFrame of (key, prediction, reference) rows and
returns BLEU-4, BLEU-1, ROUGE-1 F and ROUGE-L F per key, on whole texts.

Plan: pair rows are hash-partitioned on the key once; the n-gram explode and
the (key, n, gram) / (key, n) aggregations that follow are all clustered on
that key, so they run inside the partition without another exchange.  The
only shuffled bytes are the pair rows themselves.

ROUGE-L needs a longest common subsequence, which no SQL expression gives.
Tokens are made in the JVM; an Arrow-batched pandas UDF computes the LCS
length with the bit-parallel algorithm (Allison-Dix / Hyyro): one pass over
the reference with machine-word operations on a bitset of the prediction,
O(|a| |b| / 64), exact and on whole texts.

Stemming (``stem=True``): ROUGE tokens longer than three characters are
reduced with the Porter stemmer (``quarry.functions.porter``) in an Arrow
UDF; without it tokens are the lower-cased ``[a-z0-9]+`` runs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

BLEU_EPSILON = 0.1  # smoothing "method1": 0.1 in place of a zero numerator


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_tokens(col) -> Column:
    """``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(_c(col), r"\s+"), lambda t: t != "")


def rouge_tokens(col) -> Column:
    """Lower-case, non-``[a-z0-9]`` to space, split, drop empties."""
    t = F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", " ")
    return F.filter(F.split(t, " "), lambda x: x != "")


def _grams(tokens: Column, n: int, tag: str) -> Column:
    """array<struct<k, n, g>> of the n-grams of ``tokens``, tagged."""
    idx = F.sequence(F.lit(0), F.size(tokens) - n)
    arr = F.transform(idx, lambda i: F.struct(F.lit(tag).alias("k"), F.lit(n).alias("n"),
                                              F.array_join(F.slice(tokens, i + 1, n), " ")
                                              .alias("g")))
    empty = F.array().cast("array<struct<k:string,n:int,g:string>>")
    return F.when(F.size(tokens) >= n, arr).otherwise(empty)


def _clipped_matches(df: DataFrame, key: str, families: dict) -> DataFrame:
    """Per key and family/n: sum over grams of min(count_pred, count_ref).

    ``families`` maps a family name to (pred_tokens_col, ref_tokens_col,
    max_n).  Returns (key, fam, n, num).
    """
    parts = []
    for fam, (pcol, rcol, max_n) in families.items():
        for n in range(1, max_n + 1):
            parts.append(_grams(F.col(pcol), n, fam + ":h"))
            parts.append(_grams(F.col(rcol), n, fam + ":r"))
    ex = df.select(key, F.explode(F.concat(*parts)).alias("x")).select(
        key, F.split(F.col("x.k"), ":")[0].alias("fam"),
        (F.split(F.col("x.k"), ":")[1] == "h").alias("is_h"), F.col("x.n").alias("n"),
        F.col("x.g").alias("g"))
    per_gram = ex.groupBy(key, "fam", "n", "g").agg(
        F.count_if(F.col("is_h")).alias("hc"), F.count_if(~F.col("is_h")).alias("rc"))
    return per_gram.groupBy(key, "fam", "n").agg(
        F.sum(F.least("hc", "rc")).alias("num"))


def bleu_expr(num: list[Column], hyp_len: Column, ref_len: Column, weights) -> Column:
    """Sentence BLEU from clipped counts: method1 smoothing, brevity penalty,
    0 when no unigram matches."""
    terms = []
    for i, w in enumerate(weights):
        if w == 0:
            continue
        n = i + 1
        den = F.greatest(hyp_len - n + 1, F.lit(1)).cast("double")
        p = F.when(num[i] > 0, num[i] / den).otherwise(F.lit(BLEU_EPSILON) / den)
        terms.append(F.lit(float(w)) * F.log(p))
    s = terms[0]
    for t in terms[1:]:
        s = s + t
    bp = F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - ref_len.cast("double") / hyp_len))
    return F.when((num[0] == 0) | (hyp_len == 0), F.lit(0.0)).otherwise(bp * F.exp(s))


def _lcs_len(a, b) -> int:
    """Bit-parallel LCS length of two token sequences."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = masks.get(y)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs_len(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(ArrayType(StringType()))
def stem_tokens(toks: pd.Series) -> pd.Series:
    """Porter-stem every token longer than 3 characters (ROUGE's rule)."""
    from quarry.functions.porter import stem
    return toks.apply(lambda ts: None if ts is None else
                      [stem(t) if len(t) > 3 else t for t in ts])


def f_measure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def score_pairs(df: DataFrame, key: str, pred: str, gold: str,
                metrics=("bleu4", "bleu1", "rouge1", "rougeL"), stem: bool = False) -> DataFrame:
    """FN-5..8: (key, <metric>...) for every (key, pred, gold) row.

    ``key`` must be unique per row; join the result back on it for other
    columns.  Rows with empty text score 0.  ``stem`` applies the Porter
    stemmer to the ROUGE tokens.  Only (key, token arrays) are shuffled, once:
    the n-gram branch and the per-row branch (lengths, LCS) read the same
    exchange.
    """
    rh, rr = rouge_tokens(pred), rouge_tokens(gold)
    if stem:
        rh, rr = stem_tokens(rh), stem_tokens(rr)
    base = df.select(key, ws_tokens(pred).alias("_ph"), ws_tokens(gold).alias("_pr"),
                     rh.alias("_rh"), rr.alias("_rr"))
    n_part = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an explicit non-null key: the join below would otherwise infer this
    # filter on one branch only, and the two branches would not share the
    # exchange
    base = base.filter(F.col(key).isNotNull()).repartition(n_part, key)
    fams = {}
    if "bleu4" in metrics or "bleu1" in metrics:
        fams["b"] = ("_ph", "_pr", 4 if "bleu4" in metrics else 1)
    if "rouge1" in metrics:
        fams["r"] = ("_rh", "_rr", 1)
    out = base
    if fams:
        m = _clipped_matches(base, key, fams)
        wide = m.groupBy(key).agg(*[
            F.sum(F.when((F.col("fam") == fam) & (F.col("n") == n), F.col("num")))
            .alias(f"_{fam}{n}")
            for fam, (_, _, mx) in fams.items() for n in range(1, mx + 1)])
        out = out.join(wide, key, "left")
    hl, rl = F.size("_ph"), F.size("_pr")
    num = [F.coalesce(F.col(f"_b{n}"), F.lit(0)) for n in range(1, 5)] if "b" in fams else []
    extra = []
    if "bleu4" in metrics:
        extra.append(bleu_expr(num, hl, rl, (0.25, 0.25, 0.25, 0.25)).alias("bleu4"))
    if "bleu1" in metrics:
        extra.append(bleu_expr(num, hl, rl, (1.0, 0, 0, 0)).alias("bleu1"))
    rh, rr = F.size("_rh"), F.size("_rr")
    if "rouge1" in metrics:
        inter = F.coalesce(F.col("_r1"), F.lit(0))
        p = inter / F.greatest(rh, F.lit(1))
        r = inter / F.greatest(rr, F.lit(1))
        extra.append(f_measure(p, r).alias("rouge1"))
    if "rougeL" in metrics:
        lcs = lcs_length(F.col("_rh"), F.col("_rr"))
        p = lcs / rh
        r = lcs / rr
        extra.append(F.when((rh == 0) | (rr == 0), F.lit(0.0)).otherwise(f_measure(p, r))
                     .alias("rougeL"))
    return out.select(key, *extra)


def python_bleu(pred: str, gold: str, weights=(0.25, 0.25, 0.25, 0.25)) -> float:
    """Reference implementation for tests (small inputs only)."""
    from collections import Counter
    h, r = pred.split(), gold.split()
    nums, dens = [], []
    for n in range(1, 5):
        hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
        rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        nums.append(sum(min(c, rc[g]) for g, c in hc.items()))
        dens.append(max(1, sum(hc.values())))
    if nums[0] == 0:
        return 0.0
    ps = [(nu if nu > 0 else BLEU_EPSILON) / de for nu, de in zip(nums, dens)]
    s = sum(w * math.log(p) for w, p in zip(weights, ps) if w)
    c, rl = len(h), len(r)
    bp = 1.0 if c > rl else math.exp(1 - rl / c)
    return bp * math.exp(s)
