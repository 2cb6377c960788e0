"""URL filters: rules, and trust spread over the host graph (operator 1).

A rule is (action, host/path): it fits its host and every subdomain, for urls
whose path starts with the rule's path; the longest fitting rule decides.  Urls
without a rule get the verdict of their host's link neighbourhood:

* seeds: hosts with more than half of their pages allowed by rules are
  trusted, those with more than half blocked are distrusted;
* trust: personalised PageRank from the trusted seeds along the links; the seeds
  share a mass of 1 and a host shares its score among its links by weight;
* distrust: the blocked seeds' score taken back against the links.  A host takes
  from each host it links to the share of its own links that go there, so what it
  gets is the part of its own random walk that ends at blocked seeds.  It lies
  between 0 and 1 and does not shrink with the number of other linkers;
* a host is blocked if its distrust is above ``least`` and above its trust (times
  the number of trusted seeds); equal ones are allowed.

A host edge is an absolute or scheme-relative link in a page of one host to
another host, weighted by its pages.  Both walks run in one join per round over
an edge table written once; each round is written too, which cuts the lineage.
All scores start at the seeds' own part and only grow.  Rounds go on until what
all later rounds can still add (the largest change, times d / (1 - d)) is a
hundredth of ``least``.  The scores of a round are broadcast while their measured
bytes are under ``SMALL``; beyond that they are joined by shuffle, where Spark
splits the rows of a hot host.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; an empty host is allowed.  Null html has no links.  Repeated
pages are judged each.  Without links only seeds carry a score, their own part
of 1 - d.  DataFrame functions only.  Other columns are not
read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: The rules of the contract: (action, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
LEAST = 1e-3
#: Bytes of scores that may be broadcast.
SMALL = 16 << 20
#: The change falls by the damping factor or faster; a walk that takes longer fails.
MOST_ROUNDS = 500
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column, mark: str = "://") -> Column:
    """What follows the first ``mark``; null without one."""
    at = F.instr(url, mark)
    return F.when(at > 0, F.substr(url, at + len(mark)))


def host_of(rest: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its action (null if none fits).  ``rules``
    is a literal list: it becomes part of the plan, so a few hundred at most."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first
        at = text.index("/")
        h, p = text[:at], text[at:]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, w: how many pages of host src link to host dst."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    hosts = F.array_distinct(F.transform(links, lambda u: host_of(after_scheme(u, "//"))))
    rows = pages.select(host_of(after_scheme(F.col(url_col))).alias("src"), F.explode(hosts).alias("dst"))
    return (rows.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst")
            .agg(F.count(F.lit(1)).alias("w")))


def _fitting(df: DataFrame, text_bytes: int, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it."""
    return F.broadcast(df) if text_bytes + 64 * rows <= SMALL else df


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, least: float = LEAST) -> DataFrame:
    """host, trust (times the number of trusted seeds), distrust.  seeds: host,
    kind ('trust' or 'distrust')."""
    out = edges.groupBy("src").agg(F.sum("w").alias("all"))
    p = edges.join(out, "src").withColumn("p", F.col("w") / F.col("all"))
    walk = materialize(
        p.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "p")
        .unionByName(p.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "p")))
    own = F.lit(1.0 - damping)  # trust is kept times the number of its seeds, from the start
    state = materialize(seeds.select("kind", "host", own.alias("score"), own.alias("change")))
    for _ in range(MOST_ROUNDS):
        size = state.agg(F.max("change").alias("change"), F.count(F.lit(1)).alias("rows"),
                         F.coalesce(F.sum(F.octet_length("host")), F.lit(0)).alias("bytes")).first()
        if not size["rows"] or size["change"] * damping / (1 - damping) <= least / 100:
            break
        moving = _fitting(state.where("change > 0").select("kind", "host", "change"), size["bytes"], size["rows"])
        given = (walk.join(moving, ["kind", "host"]).groupBy("kind", F.col("to").alias("host"))
                 .agg((F.sum(F.col("change") * F.col("p")) * damping).alias("change")))
        both = state.select("kind", "host", "score", F.lit(0.0).alias("change")).unionByName(
            given.select("kind", "host", F.col("change").alias("score"), "change"))
        state = materialize(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("change").alias("change")))
    else:
        raise RuntimeError(f"the walk did not settle in {MOST_ROUNDS} rounds")
    return state.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
                                       for k in ("trust", "distrust")])


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", least: float = LEAST, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    rest = after_scheme(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(rest).alias("host"), path_of(rest).alias("path"))
    rule, action = judge(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "action": action})
    half = F.count(F.lit(1)) / 2
    votes = (judged.where("host <> ''").groupBy("host").agg(
        F.when(F.count_if(F.col("action") == "allow") > half, "trust")
        .when(F.count_if(F.col("action") == "block") > half, "distrust").alias("kind")).where("kind is not null"))
    scores = materialize(spread(materialize(host_edges(pages, url_col, html_col)), votes, damping, least))
    size = scores.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("host")), F.lit(0)).alias("bytes")).first()
    bad = (F.col("distrust") > least) & (F.col("distrust") > F.col("trust"))
    out = judged.join(_fitting(scores.withColumn("bad", bad), size["bytes"], size["rows"]), "host", "left")
    verdict = F.coalesce("action", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
