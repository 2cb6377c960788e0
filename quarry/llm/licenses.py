"""License scans by diagonal voting (operator 13).

Templates are license notices; their k-grams of words (``GRAM`` words, or the
whole phrase where it is shorter) and the rolling k-grams of every text are
hashed alike, and a join on the hash finds every place where a gram of a
template stands in a text.  A hit at word p of the text and word t of the
template votes for the diagonal p - t:

1. hits of one (text, template, diagonal) are one vote group;
2. diagonals of a text and template at most ``SLACK`` apart, as insertions and
   deletions make them, merge into one span;
3. a span is verified: its grams are compared as words, not as hashes (in the
   join), and the words that they cover must be ``LEAST`` of the template's
   words and of the span's words.

Base phrases are templates of one gram: each hit is a place, and each place
counts.  ``score`` is the largest verified share of a template in the text.

The template table is a parameter and small (a few hundred grams; it becomes a
broadcast).  Hits are few against words; they are written once and dealt out by
text, so a notice that many texts hold is no hot key; a text is one row.
DataFrame functions only.

Defined cases: a null or empty text has no words and no labels; it is returned.
Repeated rows get equal results each.  A null doc_id is returned as it is.  Two
templates may share a label.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_or_empty

#: What stands between words, after A-Z became a-z, and the words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
SLACK = 2
LEAST = 0.75
#: Fixed phrases of the contract.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Public notices (fixed texts).
NOTICES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Gaps become one space each and the text is split there: far cheaper in
    Java than extracting each word by pattern."""
    plain = F.trim(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), GAPS, " "))
    return F.array_remove(F.split(plain, " "), "")  # an empty text is one empty word


def gram_hashes(words: Column, k: int) -> Column:
    """The hash of the k words from each word on; near the end it is one of
    fewer words and equals no template's."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(words, i + j) for j in range(1, k)]))


def template_grams(spark, notices=NOTICES, phrases=PHRASES, gram: int = GRAM) -> DataFrame:
    """h, template, label, base, len, k, at, gram: one row per gram."""
    rows = [(i, label, text, base) for i, (label, text, base) in enumerate(
        [(*p, True) for p in phrases] + [(*n, False) for n in notices])]
    t = spark.createDataFrame(rows, "template int, label string, text string, base boolean")
    t = t.withColumn("words", words_of(F.col("text"))).withColumn("len", F.size("words"))
    t = t.withColumn("k", F.when(F.col("base"), F.col("len")).otherwise(F.least("len", F.lit(gram))))
    kinds = sorted({gram, *range(1, gram)} | {len(p.split()) for _, p in phrases})
    h = F.coalesce(*[F.when(F.col("k") == k, gram_hashes(F.col("words"), k)) for k in kinds])
    t = t.select("template", "label", "base", "len", "k", "words", F.posexplode(h).alias("at", "h"))
    return (t.where(F.col("at") + F.col("k") <= F.col("len"))
            .withColumn("gram", F.array_join(F.slice("words", F.col("at") + 1, F.col("k")), " ")).drop("words"))


def hits(docs: DataFrame, notices=NOTICES, phrases=PHRASES, gram: int = GRAM, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """uid, doc_id, n_words and, for every place of a template gram, the
    template's columns and the place; one row with a null template per text."""
    spark = docs.sparkSession
    table = template_grams(spark, notices, phrases, gram)
    kinds = sorted({r["k"] for r in table.select("k").distinct().collect()})
    turn = F.coalesce(*[F.when(F.col("k") == k, F.lit(i)) for i, k in enumerate(kinds)])
    mark = spark.createDataFrame([(0, 0)], "h long, k int")  # every text has one gram of length 0
    table = table.withColumn("turn", turn).unionByName(mark, allowMissingColumns=True).withColumnRenamed("h", "_h")
    # the row number names a text from here to the shuffle, in this one pass
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                       words_of(text_or_empty(text_col)).alias("words")).withColumn("n", F.size("words"))
    places = F.concat(F.array(F.lit(0).cast("long")), *[gram_hashes(F.col("words"), k) for k in kinds])
    # a column of its own: a lambda inside the explode would keep it from being compiled with the join
    rows = rows.withColumn("hashes", places).select("uid", "doc_id", "n", "words", F.posexplode("hashes").alias("j", "h"))
    # the mark comes first, then the grams of each length in turn; the length is part of a gram's hash
    place = F.col("j") - 1 - F.col("turn") * F.col("n")
    own = F.array_join(F.slice("words", F.greatest(place, F.lit(0)) + 1, F.greatest("k", F.lit(1))), " ") == F.col("gram")
    found = F.when(F.col("k") == 0, F.col("j") == 0).otherwise((place >= 0) & (place < F.col("n")) & own)
    return (rows.join(F.broadcast(table), (F.col("h") == F.col("_h")) & found)
            .select("uid", "doc_id", F.col("n").cast("long").alias("n_words"), "template", "label", "base", "len", "k", "at",
                    place.cast("long").alias("place")))


def spans(found: DataFrame, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """uid, template, label, first, last (exclusive), share, verified: the
    merged diagonals of the hits of notices."""
    votes = (found.where("not base").groupBy("uid", "template", "label", "len", "k", (F.col("place") - F.col("at")).alias("diagonal"))
             .agg(F.collect_list("at").alias("ats"), F.collect_list("place").alias("places")))
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > slack
    votes = votes.withColumn("far", F.coalesce(far.cast("int"), F.lit(0)))
    votes = votes.withColumn("span", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def covered(starts: Column) -> Column:
        """Words that the grams from these starts cover."""
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("k") - 1)))))

    merged = votes.groupBy("uid", "template", "label", "len", "k", "span").agg(
        F.flatten(F.collect_list("ats")).alias("ats"), F.flatten(F.collect_list("places")).alias("places"))
    merged = merged.select("uid", "template", "label", F.array_min("places").alias("first"),
                           (F.array_max("places") + F.col("k")).alias("last"), (covered(F.col("ats")) / F.col("len")).alias("share"),
                           covered(F.col("places")).alias("in_text"))
    return merged.withColumn("verified", (F.col("share") >= least)
                             & (F.col("in_text") >= least * (F.col("last") - F.col("first")))).drop("in_text")


def scan_licenses(docs: DataFrame, notices=NOTICES, phrases=PHRASES, gram: int = GRAM, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document; see the module's text."""
    found = materialize(hits(docs, notices, phrases, gram, id_col, text_col)).repartition("uid")
    base = F.col("base")
    places = found.groupBy("uid", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("place"))).alias("first_word"),
        F.max(F.when(base, F.col("place"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("own"))
    good = spans(found).where("verified").groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    out = places.join(good, "uid", "left")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", none))), ",").alias("labels"),
                      F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))
