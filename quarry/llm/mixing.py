"""Mixing sources to target weights by weighted fair queueing (operator 10).

Every source is a queue whose documents stand in a hash order.  A copy's
virtual finish time is the source's running total of words up to and with that
copy, divided by the source's target; the second copy of a document follows
the first copies of all.  All copies are sorted by finish time across sources,
and the sorted list is cut where its running total would exceed the budget.
At virtual time 1 each source has given its target.

Targets share ``share`` times all words by the weights 3, 1, 2, repeating over
the sources in code-point order (null last), stop at ``most`` times a source's
words, and what is over is shared again by weight.  Filling up like this has a
closed form: with the sources sorted by limit / weight, those before the first
source whose level stays under its limit are full.

Running totals (within a source and over everything) are range-partitioned
scans with per-partition offsets, so a source with a third of all rows spreads
over many tasks.  DataFrame functions only.

Defined cases: a null text has size 0.  Null is a source of its own.  Rows of
size 0 take nothing.  Repeated rows are documents of their own; rows alike in
source, id and size are interchangeable.  Empty tables, and tables without a
word, give targets and takings of 0.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, materialize, null_safe_join, text_or_empty
from quarry.operators.indexing import dense_index, running_total
from quarry.operators.sampling import group_rank

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 42


def words(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) rows -> source, source_size, target."""
    per = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                      .withColumn("_null", F.col("source").isNull()))
    ranked = dense_index(per, ["_null", "source"], "_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    lim = ranked.select("source", "source_size", "_rank", w.alias("_w"),
                        (F.col("source_size") * float(most)).alias("_limit")) \
        .withColumn("_level", F.col("_limit") / F.col("_w"))
    run = running_total(lim, ["_level", "_rank"], ["_limit", "_w"], prefix="_to_")
    total = per.agg((F.sum("source_size") * float(share)).alias("_budget"))
    all_w = lim.agg(F.sum("_w").alias("_all"))
    run = run.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_w))  # one row each
    # the level if this source and those after it share what the ones before leave
    level = ((F.col("_budget") - (F.col("_to__limit") - F.col("_limit")))
             / (F.col("_all") - (F.col("_to__w") - F.col("_w"))))
    run = run.withColumn("_here", level)
    first = (run.where(F.col("_here") <= F.col("_level"))
             .agg(F.min(F.struct("_level", "_rank", "_here"))["_here"].alias("_fill")))
    target = F.least(F.col("_limit"), F.coalesce(F.col("_fill"), F.lit(float("inf"))) * F.col("_w"))
    return run.crossJoin(F.broadcast(first)).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    words(text_col).alias("size")))
    targets = materialize(source_targets(sized, weights, share, most))
    shuffled = sized.withColumn("_null", F.col("source").isNull()) \
        .withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queued = running_total(shuffled, ["_null", "_hash", "doc_id", "size"], "size", by="source", prefix="_run_")
    queued = null_safe_join(queued, targets, ["source"], "left")
    copies = queued.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    finish = F.when(F.col("target") > 0, (F.col("_copy") * F.col("source_size") + F.col("_run_size")) / F.col("target"))
    copies = copies.select("doc_id", "source", "size", "source_size", "target", "_null", "_hash", "_copy",
                           F.coalesce(finish, F.lit(float("inf"))).alias("_finish"))
    line = running_total(copies, ["_finish", "_null", "source", "_copy", "_hash", "doc_id", "size"], "size",
                         prefix="_all_")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_words")) \
        .select((F.col("_words") * float(share)).alias("_budget"))
    line = line.crossJoin(F.broadcast(budget))  # one row
    got = (F.col("_all_size") <= F.col("_budget")) & (F.col("_finish") < float("inf"))
    return (line.groupBy("doc_id", "source", "size", "source_size", "target")
            .agg(F.sum(got.cast("int")).cast("long").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
            .withColumn("_same", (F.col("_rows") / most).cast("int"))
            # rows alike in every column share their copies out evenly
            .withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_same"))))
            .withColumn("copies", F.floor((F.col("_copies") + F.col("_same") - F.col("_k")) / F.col("_same")).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **how) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns.

    Rows that share id and source but not size are told apart by size; rows
    alike in all three share their copies out by rank, so the sum stays exact."""
    from quarry.llm.common import unused
    n, d, s, z, r, k = (unused(docs, x) for x in ("copies", "id", "source", "size", "rows", "rank"))
    taken = mix(docs, id_col, text_col, source_col, **how).groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("c"), F.count(F.lit(1)).alias("r"))
    taken = taken.where("c > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z),
                                        F.col("c").alias(n), F.col("r").alias(r))
    left = docs.withColumns({d: F.col(id_col), s: F.col(source_col), z: words(text_col)})
    taken = materialize(taken)  # numbers and ids; the second join is made only where alike rows exist
    out = null_safe_join(left, taken.where(F.col(r) == 1), [d, s, z], "inner").withColumn(k, F.lit(1).cast("long"))
    alike = taken.where(F.col(r) > 1)
    if not alike.isEmpty():
        several = null_safe_join(left, alike, [d, s, z], "inner").withColumn(k, F.xxhash64(F.col(text_col)))
        out = out.unionByName(group_rank(several, [d, s, z], k, k))
    again = unused(docs, "again")
    mine = F.floor((F.col(n) + F.col(r) - F.col(k)) / F.col(r)).cast("int")
    return (out.withColumn(n, mine).where(F.col(n) > 0)
            .withColumn(again, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns))
