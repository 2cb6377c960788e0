"""Exact deduplication by skew-safe combining (operator 2).

Texts are equal when they are identical after each run of white space became
one space.  The digest groups rows, but a group only ever merges rows whose
whole normalised text is equal, at every stage:

1. *Local*: the partial aggregate of ``groupBy(digest, salt, text)`` collapses
   the copies of a map task before anything is shuffled.
2. *Salted*: the exchange spreads a hot digest over ``salts`` reducers.  A
   digest is hot when it holds more than one in ``HOT_SHARE`` of the rows, so
   there are fewer than ``HOT_SHARE`` of them: the broadcast list of hot
   digests has that bound at every input size.  Other digests need no salt.
3. *Global*: the salt winners of hot digests (at most hot digests x salts
   texts, plus variants) meet in a second aggregate; rows of other digests
   pass through it without their text.

So every text is shuffled once at most, after local deduplication.  Decisions
join back to (id, digest) rows only.  Should two different texts share a
digest, those digests alone are grouped and joined by (digest, text).

Defined cases: a null text counts as empty.  A null id sorts after every other
id.  Of repeated rows (same id, same text) exactly one is kept.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, keep_rows, materialize, text_or_empty

HOT_SHARE = 1024


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest."""
    norm = normalise(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")) \
        .withColumn("digest", digest(F.col("norm")))
    keys = materialize(rows.select("doc_id", "digest"))
    total = keys.count()
    hot = materialize(keys.groupBy("digest").count().where(F.col("count") > max(total // HOT_SHARE, salts))
                      .select("digest", F.lit(True).alias("hot")))
    spread = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(-1)))
    salted = (spread.groupBy("digest", "salt", "norm")
              .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    is_hot = F.col("salt") >= 0
    # a group without salt is complete: its own marks keep it apart, not its text
    own = F.when(~is_hot, F.struct("first", F.xxhash64("norm").alias("h"), F.length("norm").alias("l")))
    groups = (salted.select("digest", "first", "n", own.alias("own"), F.when(is_hot, F.col("norm")).alias("hot_text"))
              .groupBy("digest", "own", "hot_text").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))
              .select("digest", "keep_id", "group_size"))
    groups = materialize(groups)
    shared = groups.groupBy("digest").count().where(F.col("count") > 1).select("digest")
    if shared.isEmpty():
        # the rows of hot digests stay where they are: their groups are as few as their digests
        mine = keys.join(F.broadcast(hot), "digest", "left")
        found = (mine.where("hot").join(F.broadcast(groups.join(F.broadcast(hot), "digest")).drop("hot"), "digest")
                 .unionByName(mine.where("hot is null").join(groups, "digest")).drop("hot"))
    else:
        clash = rows.join(shared, "digest", "left_semi")
        apart = clash.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"),
                                                    F.count(F.lit(1)).alias("group_size"))
        found = (keys.join(groups.join(shared, "digest", "left_anti"), "digest")
                 .withColumn("text_mark", F.lit(0).cast("long"))
                 .unionByName(clash.join(apart, ["digest", "norm"])
                              .withColumn("text_mark", F.xxhash64("norm")).drop("norm")))
    part = [c for c in found.columns if c in ("digest", "text_mark")] + ["doc_id"]
    nth = F.row_number().over(Window.partitionBy(*part).orderBy("doc_id"))
    return found.select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), "digest")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select("doc_id", "digest")
    keys = {"doc_id": F.col(id_col), "digest": sha256(normalise(text_or_empty(text_col)))}
    return keep_rows(docs, kept, keys)


__all__ = ["deduplicated", "exact_dedup", "normalise", "sha256"]
