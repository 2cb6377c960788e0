"""SpotSigs document fingerprints (operator 8).

Words are runs of letters and digits, lower case.  Common words are anchors
(so is the start of the text); every anchor opens a chain of the next
``CHAIN`` = 2 words that are not common, and the chain's crc32 is a signature.
A text's fingerprint is its sorted set of signatures, eight hex digits each; a
text that has no chain is its own signature, so equal texts always have equal
fingerprints.  Likeness is the sets' Jaccard share, pruned by their lengths:
it cannot exceed smaller / larger.

The work stays in regular expressions and array functions: white space and
punctuation become one space, each common word becomes a mark before the next
word, and a look-ahead from every mark reads the chain.

``edited`` pairs every document with the next one.  Neighbours come from dense
positions of the ids (a small table).  Each text is shuffled once, keyed by
id; the next document's row sends back its first characters, no more than the
quarter that is replaced, and its signatures.

Defined cases: a null text counts as empty.  Rows that share an id share the
next document, whose text is the smallest of those with the next id; a null id
comes last.  A single document is its own next one.  Other columns are not
read.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, null_safe_join, text_or_empty
from quarry.operators.indexing import dense_index

#: Common words of four languages (fixed values).
COMMON = ("the of and to a in is that for on with as was at by are be this it from or an not "
          "der die das und den von zu mit für auf ist im ein eine nicht des dem sich "
          "le la les de du et en un une dans pour par sur est que au pas "
          "el los las y se del su no lo con una por").split()
MARK = "\u0001"
SIMILAR = 0.8
#: Signatures are kept four bytes wide, as crc32 less this.
MIDDLE = 1 << 31


def _number(text: Column) -> Column:
    return (F.crc32(text.cast("binary")) - F.lit(MIDDLE)).cast("int")


def signatures(text: Column) -> Column:
    """Sorted array<int> of a text's signatures; never empty."""
    plain = F.concat(F.lit(MARK), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    words = "|".join(sorted(set(COMMON), key=lambda w: (-len(w), w)))
    marked = F.regexp_replace(plain, rf"(?<=[ {MARK}])(?:{words}) ", MARK)
    chains = F.regexp_extract_all(marked, F.lit(rf"{MARK}(?={MARK}*([^ {MARK}]+ {MARK}*[^ {MARK}]+))"), F.lit(1))
    found = F.array_distinct(F.transform(chains, lambda c: _number(F.translate(c, MARK, ""))))
    own = F.array(_number(text))
    # the lambda names the found set, so that it is worked out once
    return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, F.array_sort(f)).otherwise(own))[0]


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s.cast("long") + F.lit(MIDDLE)), 8, "0"))), "")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard share of two sets; 0 where their lengths rule ``least`` out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(small < large * F.lit(least), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edited text, their signatures and the next document's."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    sizes = materialize(rows.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("need"))
                        .withColumn("none", F.col("doc_id").isNull()))
    index = materialize(dense_index(sizes, ["none", "doc_id"], "at"))
    n = index.count()
    ask = index.select(F.col("doc_id").alias("asker"), "need", F.pmod(F.col("at") + 1, F.lit(max(n, 1))).alias("at"))
    ask = ask.join(index.select("at", "doc_id"), "at").select("doc_id", "asker", "need")
    full = rows.withColumn("sigs", signatures(F.col("text")))
    sent = null_safe_join(full, ask, ["doc_id"], "inner").select(
        F.col("asker").alias("doc_id"), F.expr("substring(text, 1, need)").alias("head"), F.col("sigs").alias("next_sigs"))
    sent = sent.groupBy("doc_id").agg(F.min(F.struct("head", "next_sigs")).alias("next"))
    out = null_safe_join(full, sent, ["doc_id"], "left")
    k = F.floor(F.length("text") / 4).cast("int")
    # substring() takes the lengths of this row
    new = F.concat(F.substr("text", F.lit(1), F.length("text") - k), F.substr(F.col("next.head"), F.lit(1), k))
    return out.select("doc_id", "text", "sigs", F.col("next.next_sigs").alias("next_sigs"), new.alias("edited")) \
        .withColumn("edited_sigs", signatures(F.col("edited")))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: digests of the texts and likenesses."""
    e = edited(docs, id_col, text_col)
    return e.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
                    pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                    pruned_jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has doc_id and class_id (documents of equal
    sets share one); pairs has the classes a < b whose sets are ``least`` alike.

    Sets are partitioned by length so that partners lie in the same partition
    or the next one.  Two sets that alike share one of the first
    n - ceil(least n) + 1 signatures of each (in signature order), so only
    those are joined, within a partition, before the pruned comparison."""
    sig = docs.select(F.col(id_col).alias("doc_id"), signatures(text_or_empty(text_col)).alias("sigs"))
    sig = materialize(sig.withColumn("key", F.sha2(as_text(F.col("sigs")).cast("binary"), 256)))
    classes = materialize(sig.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")))
    members = sig.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id")
    n = F.size("sigs")
    part = F.floor(F.log(n.cast("double")) / math.log(1 / least) + 1e-9)
    heads = classes.select("class_id", n.alias("n"), part.alias("part"), F.explode(
        F.slice("sigs", F.lit(1), (n - F.ceil(n * F.lit(least) - 1e-9) + 1).cast("int"))).alias("sig"))
    a = heads.select(F.col("class_id").alias("x"), F.col("n").alias("nx"), F.col("part"), "sig")
    b = heads.select(F.col("class_id").alias("y"), F.col("n").alias("ny"), F.col("part").alias("own"),
                     F.explode(F.array("part", F.col("part") - 1)).alias("part"), "sig")
    first = (F.col("own") > F.col("part")) | (F.col("x") < F.col("y"))
    fits = (F.col("nx") >= F.col("ny") * least - 1e-9) & (F.col("ny") >= F.col("nx") * least - 1e-9)
    found = a.join(b, ["part", "sig"]).where(first & fits).select("x", "y").distinct()
    sets = classes.select("class_id", "sigs")
    found = found.join(sets.toDF("x", "xs"), "x").join(sets.toDF("y", "ys"), "y")
    like = pruned_jaccard(F.col("xs"), F.col("ys"), least)
    pairs = found.withColumn("likeness", like).where(F.col("likeness") >= least - 1e-12)
    return members, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
