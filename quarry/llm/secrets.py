"""Secret scans: fixed patterns and sliding-window entropy (operator 3).

Base patterns (fixed): assignments, access keys and long hex runs, leftmost
and non-overlapping per kind.  Beside them every run of ``WINDOW`` or more key
characters is a candidate string; ``/``, ``=``, ``-`` and ``_`` end a run, so the
parts of a path, of an identifier or of ``name=value`` stand alone.  What a base match or an allow-list
pattern (documented examples, the alphabet) covers is cut out of a candidate, and
the pieces left of ``WINDOW`` characters or more are judged, so only windows that
touch such a match are suppressed.  A window of ``WINDOW`` characters slides over a
piece; the window keeps a count per character, and when a character enters or
leaves, only that character's term n log2 n of the sum changes, so

    entropy = log2(WINDOW) - sum(n log2 n) / WINDOW

needs no recount.  Each character class has its own threshold: hex digits, letters
alone, and letters with digits; digits alone are never reported.  A test holds the
thresholds against random keys and against words.  The span runs from the first
to the last window above the threshold.  Column functions only; no shuffle.

Defined cases: a null text counts as empty; a text without a match has empty
spans.  Positions count code points, the end is exclusive.  Repeated rows get
equal results.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty

#: Fixed patterns: kind, pattern, least length (of group 2 for assignments).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole match has 20 characters or more
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+"
#: class, pattern of the whole piece, least entropy in bits per character
CLASSES = (("entropy_hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0), ("entropy_letters", r"^[A-Za-z+]+$", 3.95),
           ("entropy_mixed", r"[A-Za-z]", 3.6))
ALLOWED = (r"(?i)example|dummy|placeholder|changeme|sample|abcdefghij|0123456789",)
_SPANS = "array<struct<m:string,s:bigint,e:bigint>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<m, s, e>>: all matches with their code-point places; the
    text between the matches gives the starts."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    none = F.array().cast(_SPANS)

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        here = F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], here)).alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), add, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _term(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def hot_range(m: Column, least: Column) -> Column:
    """struct<lo, hi>: from the first to the last window of ``m`` whose
    entropy reaches ``least`` (null if none does)."""
    places = F.transform(F.split(m, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("sum"),
                    F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def step(codes: Column, bits: Column, acc: Column, i: Column) -> Column:
        new = F.element_at(codes, i)
        old = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
        n_new = F.element_at(acc["n"], new + 1)
        total = acc["sum"] + _term(n_new + 1) - _term(n_new)
        # the leaving character's count, with the entering one already counted
        n_old = F.element_at(acc["n"], old + 1) + F.when(old == new, 1).otherwise(0)
        total = F.when(old > 0, total + _term(n_old - 1) - _term(n_old)).otherwise(total)
        counts = F.transform(acc["n"], lambda x, j: x + F.when(j == new, 1).otherwise(0)
                             - F.when((old > 0) & (j == old), 1).otherwise(0))
        hot = (i >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= bits)
        return F.struct(counts.alias("n"), total.alias("sum"),
                        F.when(hot, F.coalesce(acc["lo"], i - WINDOW)).otherwise(acc["lo"]).alias("lo"),
                        F.when(hot, i).otherwise(acc["hi"]).alias("hi"))

    # the outer lambda names codes and threshold, so that they are worked out once and not at every step
    once = F.array(F.struct(places.alias("codes"), least.alias("bits")))
    return F.transform(once, lambda o: F.aggregate(
        F.sequence(F.lit(1), F.size(o["codes"])), zero, lambda acc, i: step(o["codes"], o["bits"], acc, i),
        lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))[0]


def _pieces(x: Column, base: Column, plain: str) -> Column:
    """What base matches and allowed words leave of candidate ``x``, in pieces
    of WINDOW characters or more: array<struct<m, s, e>>."""
    hit = F.filter(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    cuts = F.array_sort(F.concat(F.transform(hit, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))),
                                 F.transform(located(x["m"], plain), lambda a: F.struct((x["s"] + a["s"]).alias("s"),
                                                                                        (x["s"] + a["e"]).alias("e")))))
    # gaps between the cuts: each cut ends a piece, and the candidate's end ends the last
    ends = F.concat(cuts, F.array(F.struct(x["e"].alias("s"), x["e"].alias("e"))))

    def add(acc: Column, c: Column) -> Column:
        n = c["s"] - acc["at"]
        here = F.array(F.struct(F.substr(x["m"], (acc["at"] - x["s"] + 1).cast("int"), n.cast("int")).alias("m"),
                                acc["at"].alias("s"), c["s"].alias("e")))
        return F.struct(F.greatest(acc["at"], c["e"]).alias("at"),
                        F.when(n >= WINDOW, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ends, F.struct(x["s"].alias("at"), F.array().cast(_SPANS).alias("out")), add, lambda a: a["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES,
         allowed=ALLOWED) -> DataFrame:
    """doc_id, base, more: arrays of struct<s, rank, kind, e, m> in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    t = F.col("t")
    rows = rows.select("doc_id", located(t, ASSIGN).alias("assign"), located(t, ACCESS).alias("access"),
                       located(t, HEX).alias("hex"), located(t, CANDIDATE).alias("cand"))

    def named(col, kind: str, rank: int) -> Column:
        return F.transform(col, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"),
                                                   F.lit(kind).alias("kind"), x["e"].alias("e"), x["m"].alias("m")))

    long_value = F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    rows = rows.select("doc_id", "cand", F.sort_array(F.concat(
        named(long_value, "assign", 0), named(F.col("access"), "access", 1), named(F.col("hex"), "hex", 2))).alias("base"))
    plain = "|".join(f"(?:{p})" for p in allowed) or r"(?!)"
    rows = rows.select("doc_id", "base", F.flatten(F.transform("cand", lambda x: _pieces(x, F.col("base"), plain))).alias("cand"))
    patterns = [p for _, p, _ in classes]

    def class_of(m: Column) -> Column:
        """The first class that fits, from 0; null if none does."""
        return F.coalesce(*[F.when(m.rlike(p), F.lit(k)) for k, p in enumerate(patterns)])

    def least_of(m: Column) -> Column:
        return F.coalesce(*[F.when(m.rlike(p), F.lit(float(bits))) for _, p, bits in classes])

    names = F.array(*[F.lit(k) for k, _, _ in classes])
    judged = F.transform("cand", lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), class_of(x["m"]).alias("k"),
                                                    hot_range(x["m"], least_of(x["m"])).alias("r")))
    hot = F.filter(judged, lambda x: x["k"].isNotNull() & x["r"]["hi"].isNotNull())
    more = F.transform(hot, lambda x: F.struct((x["s"] + x["r"]["lo"]).alias("s"), (x["k"] + 3).alias("rank"),
                                               F.element_at(names, x["k"] + 1).alias("kind"),
                                               (x["s"] + x["r"]["hi"]).alias("e"), x["m"].alias("m")))
    return rows.select("doc_id", "base", F.sort_array(more).alias("more"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"),
                                                                 x["e"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")),
                        F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        as_text(F.sort_array(F.concat("base", "more"))).alias("spans"))
