"""Vector column functions (FN-1, FN-2, FN-3, PRJ-13, PRJ-14).

All of these are Catalyst expressions over ``array<double>`` columns, so they
run in the JVM next to the scan.  Spark has no built-in vector similarity, so
dot products are ``aggregate(zip_with(...))``: linear in the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_vector(col) -> Column:
    """PRJ-14: any numeric array (float / int / double) -> array<double>."""
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """FN-1: cosine similarity; a zero vector gives 0 (not NaN).

    Pass precomputed norms when one side is reused (e.g. a centroid).
    """
    na = _c(norm_a) if norm_a is not None else norm(a)
    nb = _c(norm_b) if norm_b is not None else norm(b)
    den = na * nb
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def cosine_distance(a, b, norm_a=None, norm_b=None) -> Column:
    return F.lit(1.0) - cosine(a, b, norm_a, norm_b)


def sq_euclidean(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda s, v: s + v)


def euclidean(a, b) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def unit(a) -> Column:
    """Vector scaled to unit length; the zero vector stays zero."""
    a = _c(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def logit_margin(col) -> Column:
    """FN-2 / SRT-5: top-1 minus top-2 in one pass over the array.

    A single element returns itself; ties give 0.  One ``aggregate`` keeps
    the two largest values, so a 32k-wide logits row is not sorted.
    """
    c = _c(col)
    ninf = F.lit(float("-inf"))
    top2 = F.aggregate(
        c,
        F.struct(ninf.alias("m1"), ninf.alias("m2")),
        lambda acc, x: F.when(x > acc["m1"], F.struct(x.alias("m1"), acc["m1"].alias("m2")))
        .when(x > acc["m2"], F.struct(acc["m1"].alias("m1"), x.alias("m2")))
        .otherwise(acc),
    )
    return (F.when(F.size(c) == 1, c[0])
            .when(F.size(c) > 1, top2["m1"] - top2["m2"]))


def normalised_margin(margin, max_margin: float = 5.0) -> Column:
    """FN-3: margin / max_margin, deliberately unclamped."""
    return _c(margin) / F.lit(float(max_margin))


def wide_columns(col, dim: int, prefix: str = "dim_") -> list[Column]:
    """PRJ-13: vector -> ``dim_0 .. dim_{d-1}`` projection."""
    c = _c(col)
    return [c[j].alias(f"{prefix}{j}") for j in range(dim)]
