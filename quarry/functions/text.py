"""Text column functions (FN-4, FN-10..19, FN-22, FN-24, FN-25, FN-27, FN-28,
PRJ-9, PRJ-11).  All are Catalyst expressions; none is a Python UDF.

Note: Java regex ``\\d`` matches ASCII digits only (Python's matches any
Unicode digit); the DuckDB oracle (RE2) agrees with Java here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword stop list of the reference, in its order.
STOP_WORDS = ["the", "a", "an", "in", "on", "at", "to", "for", "of",
              "and", "or", "is", "are", "this", "that", "it", "as"]
# The number pattern and the final-answer pattern.
NUMBER_RE = r"(-?\d+\.?\d*)"
FINAL_ANSWER_RE = r"final answer\s*is\s*:?\s*(-?\d+\.?\d*)"
GOLD_NUMBER_RE = r"####\s*(-?\d+)"
MAX_ANSWER = 1e6
# Python str.strip() whitespace, ASCII part (Spark trim strips spaces only).
WS = " \t\n\r\x0b\x0c"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """PRJ-11 helper: Python ``str.strip()`` on ASCII whitespace."""
    return F.btrim(_c(col), F.lit(WS))


def normalise_ws(col) -> Column:
    """PRJ-11: ``.strip().replace('\\n', ' ')``."""
    return F.replace(strip(col), F.lit("\n"), F.lit(" "))


def structure_tag(col) -> Column:
    """FN-18: ``lower(trim(source))``, empty or null -> ``unknown``."""
    t = F.lower(strip(_c(col)))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def keywords(text, extra=None) -> Column:
    """FN-4: sorted distinct words that are lower-case, longer than 3
    characters, only letters, and not stop words.  ``extra`` (the prompt, or
    an array of context strings) is appended after a space."""
    t = _c(text).cast("string")
    if extra is not None:
        e = _c(extra)
        t = F.concat_ws(" ", F.coalesce(t, F.lit("")), e)
    words = F.split(F.lower(t), r"\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    keep = F.filter(words, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+$")
                    & ~F.array_contains(stop, w))
    return F.array_sort(F.array_distinct(keep))


def keyword_overlap(a, b) -> Column:
    """FN-20: |A & B| / max(|B|, 1)."""
    return F.size(F.array_intersect(_c(a), _c(b))) / F.greatest(F.size(_c(b)), F.lit(1))


def _valid_int(v: Column) -> Column:
    """Finite, |v| < 1e6, truncated toward zero (Python ``int(float)``)."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(MAX_ANSWER))
    return F.when(ok, v.cast("int"))


def gold_number(col) -> Column:
    """FN-10: the integer after ``####``; null when absent."""
    s = F.regexp_extract(_c(col), GOLD_NUMBER_RE, 1)
    return F.when(s != "", s.try_cast("int"))


def final_answer_number(col) -> Column:
    """FN-11: lower-cased ``final answer is: <n>``; else the first number of
    the last line that has one among the last five lines of the stripped
    text.  Valid when finite and |v| < 1e6; truncated to int."""
    t = _c(col)
    m = F.regexp_extract(F.lower(t), FINAL_ANSWER_RE, 1)
    last5 = F.slice(F.reverse(F.split(strip(t), "\n")), 1, 5)
    line = F.try_element_at(F.filter(last5, lambda l: l.rlike(NUMBER_RE)), F.lit(1))
    fb = F.regexp_extract(line, NUMBER_RE, 1)
    s = F.when(m != "", m).otherwise(F.nullif(fb, F.lit("")))
    return _valid_int(s.try_cast("double"))


def nearest_number(col, label) -> Column:
    """FN-12: of all numbers in the text that are finite and under 1e6 in
    magnitude, the one closest to the label (first on ties), as int."""
    nums = F.regexp_extract_all(_c(col), F.lit(NUMBER_RE), 1)
    lab = _c(label).cast("double")
    vals = F.filter(F.transform(nums, lambda x: x.try_cast("double")),
                    lambda v: v.isNotNull() & (F.abs(v) < F.lit(MAX_ANSWER)))
    cand = F.transform(vals, lambda v, i: F.struct(F.abs(v - lab).alias("d"),
                                                     i.alias("i"), v.alias("v")))
    best = F.array_min(cand)
    return F.when(F.size(vals) > 0, best["v"].cast("int"))


def first_int(col) -> Column:
    """FN-13: first standalone integer ``\\b(\\d+)\\b``."""
    s = F.regexp_extract(_c(col), r"\b(\d+)\b", 1)
    return F.when(s != "", s.try_cast("int"))


def first_digit(col) -> Column:
    """FN-14: first digit character as int."""
    s = F.regexp_extract(_c(col), r"(\d)", 1)
    return F.when(s != "", s.cast("int"))


def after_last(col, marker: str = "Answer:") -> Column:
    """FN-15: text after the last ``marker`` (the whole text if absent)."""
    return F.element_at(F.split(_c(col), F.lit(marker), -1), -1)


def strip_prompt(col, prompt) -> Column:
    """FN-15: remove the echoed prompt."""
    return F.replace(_c(col), _c(prompt), F.lit(""))


def decision(col) -> Column:
    """FN-16: ``yes`` when the lower-cased text contains "yes", else ``no``."""
    return F.when(F.lower(_c(col)).contains("yes"), F.lit("yes")).otherwise(F.lit("no"))


def contains_ci(haystack, needle) -> Column:
    """FN-17: case-insensitive containment."""
    return F.lower(_c(haystack)).contains(F.lower(_c(needle)))


def first_truthy(*cols) -> Column:
    """FN-19: first value, as a string, that is not absent; a column's type says
    what is: null, the empty string, false, a zero of any numeric type.  The
    string "0" and NaN are present."""
    parts = []
    for c in cols:
        s, kind = _c(c).cast("string"), F.typeof(_c(c))
        present = (F.when(kind == "string", s != "").when(kind == "boolean", s != "false")
                   .otherwise(F.coalesce(s.try_cast("double") != 0, F.lit(True))))
        parts.append(F.when(s.isNotNull() & present, s))
    return F.coalesce(*parts)


def chunks(col, size: int = 5000) -> Column:
    """FN-22: array of consecutive ``size``-character pieces covering the
    whole text (the last piece may be shorter).  Use with ``posexplode``."""
    t = _c(col)
    n = F.greatest(F.ceil(F.length(t) / F.lit(size)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.substring(t, i * size + 1, F.lit(size)))


def truncate(col, n: int = 512) -> Column:
    """FN-24: the first ``n`` characters (the reference's model-input cut)."""
    return F.substring(_c(col), 1, n)


def fingerprint(config_map) -> Column:
    """FN-25: first 8 hex digits of the MD5 of the config, keys sorted."""
    m = _c(config_map)
    return F.substring(F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))), 1, 8)


def composite_text(*cols) -> Column:
    """FN-27: the text handed to an encoder, pieces joined by a space."""
    return F.concat_ws(" ", *[_c(c) for c in cols])


def cluster_label(bucket, n) -> Column:
    """FN-28: ``{bucket}_cluster_{n}``."""
    return F.concat(_c(bucket), F.lit("_cluster_"), _c(n).cast("string"))


def anomaly_label(cluster_id) -> Column:
    """FN-28: ``anomaly_cluster_{id}``."""
    return F.concat(F.lit("anomaly_cluster_"), _c(cluster_id).cast("string"))


def section(col, name: str, stops=("\n\n",)) -> Column:
    """PRJ-9: text after ``name:`` up to the first stop (dot matches
    newline), stripped."""
    alt = "|".join(["(?:" + s.replace("\n", "\\n") + ")" for s in stops] + ["$"])
    pat = f"(?s){name}:(.*?)(?:{alt})"
    return strip(F.regexp_extract(_c(col), pat, 1))
