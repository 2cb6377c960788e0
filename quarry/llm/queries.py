"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


_DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)"""


@query("op2_exact_dedup", _DEDUP_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.exact_dedup import exact_dedup
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import best_fit_pack
    return best_fit_pack(documents(spark, sf_dir), digest=True)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import toxicity
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS k
        FROM sized GROUP BY source),
lim AS (SELECT *, [3.0, 1.0, 2.0][(k % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2 AS cap FROM per),
-- a round shares what the full sources leave; a source above its limit is full from then on
fill AS (
  SELECT 0 AS round, k, w, cap, false AS is_full, false AS done FROM lim
  UNION ALL
  SELECT round + 1, k, w, cap, is_full OR over, NOT bool_or(over AND NOT is_full) OVER () FROM (
    SELECT *, cap < w * ((SELECT sum(source_size) * 1.5::DOUBLE FROM per) - coalesce(sum(cap) FILTER (is_full) OVER (), 0))
                  / nullif(sum(w) FILTER (NOT is_full) OVER (), 0) AS over
    FROM fill WHERE NOT done)),
level AS (SELECT ((SELECT sum(source_size) * 1.5::DOUBLE FROM per) - coalesce(sum(cap) FILTER (is_full), 0))
                 / nullif(sum(w) FILTER (NOT is_full), 0) AS v FROM fill WHERE done),
targets AS (SELECT source, k, source_size, least(cap, coalesce((SELECT v FROM level), 'inf'::DOUBLE) * w) AS target FROM lim),
queued AS (
  SELECT d.doc_id, d.source, d.size, t.k, t.source_size, t.target, md5('42:' || coalesce(d.doc_id::VARCHAR, '')) AS h,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id
                           ROWS UNBOUNDED PRECEDING) AS run
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT q.*, c, (c * source_size + run)::DOUBLE / target AS finish FROM queued q, (VALUES (0), (1)) AS v(c) WHERE target > 0),
line AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, k, c, h, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM copies),
got AS (SELECT doc_id, count(*) AS n FROM line WHERE total <= (SELECT sum(source_size) * 1.5::DOUBLE FROM per) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, round(q.target, 3) AS target, (coalesce(g.n, 0) * q.size)::BIGINT AS taken
FROM queued q LEFT JOIN got g USING (doc_id)"""


@query("op10_mixing", _MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import near_duplicates
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.langid import identify
    return identify(documents(spark, sf_dir))


@query("op1_url_filters")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filter import filter_urls
    return filter_urls(table(spark, sf_dir, "pages"))


@query("op3_secret_scans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secrets import scan, summary
    return summary(scan(documents(spark, sf_dir)))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_counts import token_counts
    return token_counts(documents(spark, sf_dir))


@query("op8_spotsigs")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.spotsigs import compare
    return compare(documents(spark, sf_dir))


_HARD_SQL = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INT AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""


@query("op11_hard_negatives", _HARD_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.hard_negatives import hard_negatives, integer_vectors
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


_SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * n.n * docs) // len))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


@query("op12_lexical_search", _SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lexical_search import lexical_search
    return lexical_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def _license_sql() -> str:
    """The same voting over strings: words, grams, diagonals, merged spans."""
    from quarry.llm.licenses import GRAM, LEAST, NOTICES, PHRASES, SLACK, WORDS
    rows = ", ".join("({}, '{}', '{}', {})".format(i, label, text.lower().replace("'", "''"), base) for i, (label, text, base) in
                     enumerate([(*p, True) for p in PHRASES] + [(*n, False) for n in NOTICES]))
    return rf"""
WITH t AS (SELECT id, label, base, regexp_extract_all(text, '{WORDS}') AS w FROM (VALUES {rows}) AS v(id, label, text, base)),
tk AS (SELECT *, len(w) AS len, CASE WHEN base THEN len(w) ELSE least(len(w), {GRAM}) END AS k FROM t),
tg AS (SELECT id, label, base, len, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS gram
       FROM (SELECT *, unnest(range(len - k + 1)) AS pos FROM tk)),
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
dw AS (SELECT uid, w, unnest(range(len(w))) AS place FROM d),
dg AS (SELECT uid, place, k, array_to_string(w[place + 1 : place + k], ' ') AS gram
       FROM dw, (SELECT DISTINCT k FROM tk) WHERE place + k <= len(w)),
h AS (SELECT uid, place, id, label, base, len, tg.k, pos, place - pos AS diagonal FROM dg JOIN tg ON dg.k = tg.k AND dg.gram = tg.gram),
b AS (SELECT uid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
             list_sort(list(DISTINCT label)) AS own FROM h WHERE base GROUP BY uid),
dia AS (SELECT uid, id, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY uid, id ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS far
        FROM (SELECT DISTINCT uid, id, diagonal FROM h WHERE NOT base)),
sp AS (SELECT *, sum(far) OVER (PARTITION BY uid, id ORDER BY diagonal) AS span FROM dia),
v AS (SELECT h.uid, h.id, sp.span, label, len, min(place) AS first, max(place + k) AS last,
             len(list_distinct(flatten(list(range(pos, pos + k))))) AS in_template,
             len(list_distinct(flatten(list(range(place, place + k))))) AS in_text
      FROM h JOIN sp USING (uid, id, diagonal) WHERE NOT base GROUP BY ALL),
g AS (SELECT uid, list(DISTINCT label) AS more, max(in_template / len) AS share FROM v
      WHERE in_template >= {LEAST} * len AND in_text >= {LEAST} * (last - first) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(own, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (uid) LEFT JOIN g USING (uid)"""


@query("op13_license_scans", _license_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.licenses import scan_licenses
    return scan_licenses(documents(spark, sf_dir))
