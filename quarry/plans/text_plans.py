"""M2: samples and text queries over ``documents`` and ``conversations``.

Fixture roles: a ``documents`` row is a QA record (question = text, context =
source, long answer = lang, numeric answer = n_chars); its ``lang`` picks the
source template.  A conversation *pair* is a user turn followed by an
assistant turn (next turn number): prompt = user text, completion = assistant
text.  Every query reads whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import samples as S
from quarry.plans.registry import register
from quarry.sources.tables import table

# SQL spelling of Python's ASCII whitespace set for trim().
WS_SQL = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
NL = "chr(10)"


def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    src = (F.when(F.col("lang") == "en", "trivia_qa").when(F.col("lang") == "fr", "pubmedqa")
           .when(F.col("lang") == "de", "gsm8k").otherwise("lex_glue"))
    return d.select(
        F.col("doc_id").alias("sample_id"), src.alias("dataset"),
        F.col("text").alias("question"),
        F.concat(F.col("source"), F.lit(" #### "), F.col("n_chars").cast("string")).alias("answer"),
        F.col("source").alias("context"), F.col("lang").alias("long_answer"),
        F.when(F.col("n_chars") > 1000, "yes").otherwise("no").alias("final_decision"),
        F.col("lang").alias("endings"), F.col("n_chars").alias("label"))


QA_SQL = f"""
qa AS (
  SELECT doc_id AS sample_id,
         CASE lang WHEN 'en' THEN 'trivia_qa' WHEN 'fr' THEN 'pubmedqa'
                   WHEN 'de' THEN 'gsm8k' ELSE 'lex_glue' END AS dataset,
         text AS question, source || ' #### ' || CAST(n_chars AS VARCHAR) AS answer,
         source AS context, lang AS long_answer,
         CASE WHEN n_chars > 1000 THEN 'yes' ELSE 'no' END AS final_decision,
         lang AS endings, n_chars AS label
  FROM documents),
fmt AS (
  SELECT sample_id,
    CASE WHEN dataset = 'lex_glue' THEN '[Context]' || {NL} || context
         ELSE '[Question]' || {NL} || question END AS text,
    CASE dataset
      WHEN 'trivia_qa' THEN '[Context]' || {NL} || {NL} || '[Answer]' || {NL} || answer
      WHEN 'pubmedqa' THEN '[Context]' || {NL} || context || {NL} || {NL} || '[Answer Options]'
                           || {NL} || long_answer || {NL} || {NL} || '[Final Decision]' || {NL}
                           || final_decision
      WHEN 'gsm8k' THEN ' [Answer]' || {NL} || answer || ' ' || {NL} || ' The final answer is: '
                        || regexp_extract(trim(answer, {WS_SQL}), '####\\s*(-?\\d+)', 1)
      ELSE '[Answer Options]' || {NL} || endings || {NL} || {NL} || '[Final Decision]' || {NL}
           || CAST(label AS VARCHAR) END AS full_prompt,
    dataset AS source,
    CASE WHEN dataset = 'trivia_qa' THEN 0 ELSE 1 END AS label,
    CASE dataset WHEN 'trivia_qa' THEN answer WHEN 'pubmedqa' THEN final_decision
                 WHEN 'gsm8k' THEN regexp_extract(trim(answer, {WS_SQL}), '####\\s*(-?\\d+)', 1)
                 ELSE CAST(label AS VARCHAR) END AS real_answer
  FROM qa)"""


def formatted_documents(spark, sf_dir) -> DataFrame:
    qa = qa_records(spark, sf_dir)
    return S.format_samples(qa, F.col("dataset"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn followed by an assistant turn, per conversation.

    ``turn`` numbers a conversation's turns consecutively, so "the next
    turn" is an equi-join on (conv_id, turn + 1): it hashes on both columns,
    so one very long conversation spreads over many tasks instead of one
    window partition (the DuckDB oracle uses ``lead`` and agrees).
    """
    c = table(spark, sf_dir, "conversations")
    cur = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"))
    nxt = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return cur.join(nxt, ["conv_id", "turn"], "inner")


PAIRS_SQL = """
pairs AS (
  SELECT conv_id, turn, prompt, completion FROM (
    SELECT conv_id, turn, role, text AS prompt,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS completion,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
    FROM conversations) t
  WHERE role = 'user' AND next_role = 'assistant')"""


@register("format_prompt", operators=("PRJ-1", "PRJ-10", "FN-10", "FN-18"),
          sql="WITH " + QA_SQL + "\nSELECT sample_id, text, full_prompt, source, label, "
                                 "real_answer FROM fmt")
def q_format_prompt(spark, sf_dir):
    return formatted_documents(spark, sf_dir)


@register("union_sources", operators=("SET-1", "PRJ-2", "SRC-3"),
          sql="WITH " + QA_SQL + "," + PAIRS_SQL + f"""
SELECT 'documents' AS origin, CAST(sample_id AS VARCHAR) AS sample_id, text, full_prompt, source, label, real_answer FROM fmt
UNION ALL
SELECT 'conversations' AS origin, conv_id || ':' || turn AS sample_id,
       '[Question]' || {NL} || prompt AS text, '[Answer]' || {NL} || completion AS full_prompt,
       'gsm8k' AS source, 1 AS label, CAST(conv_id AS VARCHAR) AS real_answer
FROM pairs""")
def q_union_sources(spark, sf_dir):
    docs = formatted_documents(spark, sf_dir).withColumns({
        "origin": F.lit("documents"), "sample_id": F.col("sample_id").cast("string")})
    pairs = conversation_pairs(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("sample_id"), "prompt", "completion",
        F.col("conv_id").cast("string").alias("label"))
    js = S.format_json_samples(pairs).withColumn("origin", F.lit("conversations"))
    return S.union_samples(docs, js).select("origin", "sample_id", "text", "full_prompt",
                                            "source", "label", "real_answer")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@register("keywords", operators=("FN-4", "AGG-22"), sql=f"""
SELECT doc_id,
  array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'),
      lambda w: length(w) > 3 AND regexp_full_match(w, '\\p{{L}}+')
                AND NOT list_contains({STOP_SQL}, w)))), ' ') AS keywords,
  CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'),
      lambda w: length(w) > 3 AND regexp_full_match(w, '\\p{{L}}+')
                AND NOT list_contains({STOP_SQL}, w)))) AS INTEGER) AS n_keywords
FROM documents""")
def q_keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kw = T.keywords("text")
    return d.select("doc_id", F.array_join(kw, " ").alias("keywords"),
                    F.size(kw).alias("n_keywords"))


def _final_sql(t: str) -> str:
    fa = f"regexp_extract(lower({t}), 'final answer\\s*is\\s*:?\\s*(-?\\d+\\.?\\d*)', 1)"
    fb = (f"regexp_extract(list_filter(list_reverse(string_split(trim({t}, {WS_SQL}), {NL}))[1:5], "
          f"lambda l: regexp_matches(l, '-?\\d+\\.?\\d*'))[1], '(-?\\d+\\.?\\d*)', 1)")
    v = f"try_cast(CASE WHEN {fa} <> '' THEN {fa} ELSE nullif({fb}, '') END AS DOUBLE)"
    return f"CASE WHEN abs({v}) < 1e6 THEN CAST(trunc({v}) AS INTEGER) END"


@register("numeric_answer", operators=("FN-10", "FN-11", "FN-13", "FN-14", "FLT-4"), sql=f"""
WITH o AS (
  SELECT doc_id, n_chars, text,
         CASE WHEN lang = 'en' THEN text || {NL} || 'So the Final Answer is: '
                                    || CAST(n_chars AS VARCHAR)
              ELSE text END AS output_text,
         source || ' #### ' || CAST(n_chars AS VARCHAR) AS gold_text
  FROM documents)
SELECT doc_id,
  {_final_sql('output_text')} AS pred,
  CAST(nullif(regexp_extract(gold_text, '####\\s*(-?\\d+)', 1), '') AS INTEGER) AS gold,
  try_cast(nullif(regexp_extract(text, '\\b(\\d+)\\b', 1), '') AS INTEGER) AS first_int,
  CAST(nullif(regexp_extract(text, '(\\d)', 1), '') AS INTEGER) AS first_digit
FROM o
WHERE regexp_extract(gold_text, '####\\s*(-?\\d+)', 1) <> ''""")
def q_numeric_answer(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = F.when(F.col("lang") == "en",
                 F.concat(F.col("text"), F.lit("\nSo the Final Answer is: "),
                          F.col("n_chars").cast("string"))).otherwise(F.col("text"))
    gold_text = F.concat(F.col("source"), F.lit(" #### "), F.col("n_chars").cast("string"))
    o = d.select("doc_id", "text", out.alias("output_text"), gold_text.alias("gold_text"))
    o = o.filter(F.regexp_extract("gold_text", T.GOLD_NUMBER_RE, 1) != "")  # FLT-4
    return o.select("doc_id", T.final_answer_number("output_text").alias("pred"),
                    T.gold_number("gold_text").alias("gold"),
                    T.first_int("text").alias("first_int"),
                    T.first_digit("text").alias("first_digit"))


@register("nearest_number", operators=("FN-12",), sql="""
WITH v AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) / 100.0 AS lab,
    list_filter(list_transform(regexp_extract_all(text, '(-?\\d+\\.?\\d*)', 1),
                               lambda x: try_cast(x AS DOUBLE)),
                lambda x: x IS NOT NULL AND abs(x) < 1e6) AS vals
  FROM documents)
SELECT doc_id,
  CASE WHEN len(vals) > 0 THEN
    CAST(trunc(list_min(list_transform(vals, lambda x, i: {'d': abs(x - lab), 'i': i, 'v': x})).v)
         AS INTEGER) END AS pred
FROM v""")
def q_nearest_number(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lab = F.col("n_chars").cast("double") / 100.0
    return d.select("doc_id", T.nearest_number("text", lab).alias("pred"))


@register("first_truthy", operators=("FN-19",), sql="""
SELECT d.doc_id,
  coalesce(CAST(nullif(l.quality, 0) AS VARCHAR), CAST(nullif(l.toxic, 0) AS VARCHAR), nullif(d.lang, '')) AS answer
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_first_truthy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select("doc_id", T.first_truthy("quality", "toxic", "lang").alias("answer"))


@register("chunk_text", operators=("FN-22",), sql="""
WITH c AS (
  SELECT doc_id, text,
         unnest(range(0, CAST(greatest(ceil(length(text) / 5000.0), 1) AS BIGINT))) AS pos
  FROM documents)
SELECT doc_id, pos, CAST(length(substring(text, CAST(pos * 5000 + 1 AS BIGINT), 5000)) AS BIGINT) AS chunk_len,
       md5(substring(text, CAST(pos * 5000 + 1 AS BIGINT), 5000)) AS chunk_md5
FROM c""")
def q_chunk_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = d.select("doc_id", F.posexplode(T.chunks("text", 5000)).alias("pos", "chunk"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"),
                    F.length("chunk").cast("long").alias("chunk_len"),
                    F.md5("chunk").alias("chunk_md5"))


@register("label_encode", operators=("PRJ-16", "PRJ-12"), sql="""
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_id,
       CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS global_index,
       'sample_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS uid
FROM documents""")
def q_label_encode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    enc = S.label_encode(d, "lang", "lang_id")
    return S.sample_ids(enc, "doc_id").select("doc_id", "lang", "lang_id", "global_index", "uid")


CHOICE_SQL = "WITH " + PAIRS_SQL + f""",
mc AS (
  SELECT conv_id, turn, prompt AS context,
         string_split(trim(completion, {WS_SQL}), {NL}) AS endings,
         CAST(length(prompt) % 4 AS INTEGER) AS label
  FROM pairs),
p AS (
  SELECT conv_id, turn, label,
    'Given the following legal context and options, choose the most appropriate option.'
    || {NL} || {NL} || 'Context: ' || replace(trim(context, {WS_SQL}), {NL}, ' ') || {NL} || {NL}
    || 'Options:' || {NL}
    || array_to_string(list_transform(endings, lambda x, i: CAST(i - 1 AS VARCHAR) || '. ' || x || {NL}), '')
    || {NL} || 'Answer:' AS prompt,
    CAST(label AS VARCHAR) AS completion
  FROM mc WHERE label >= 0 AND label < len(endings))"""


@register("multi_choice", operators=("PRJ-3", "PRJ-9", "PRJ-11", "FLT-3"), sql=CHOICE_SQL + f"""
SELECT conv_id, turn, label, prompt, completion,
  trim(regexp_extract(prompt, '(?s)Context:(.*?)(?:\\n\\n|Options:)', 1), {WS_SQL}) AS parsed_context,
  trim(regexp_extract(prompt, '(?s)Options:\\n(.*?)(?:\\n\\nAnswer:|\\nAnswer:)', 1), {WS_SQL})
    AS parsed_options
FROM p""")
def q_multi_choice(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    mc = pairs.select("conv_id", "turn", F.col("prompt").alias("context"),
                      F.split(T.strip("completion"), "\n").alias("endings"),
                      (F.length("prompt") % 4).cast("int").alias("label"))
    from quarry.operators.buffer_ops import parse_sections
    return parse_sections(S.multi_choice_prompt(mc)).select(
        "conv_id", "turn", "label", "prompt", "completion", F.col("context").alias("parsed_context"),
        F.col("options").alias("parsed_options"))


@register("qa_prompts", operators=("PRJ-4", "PRJ-5", "FLT-1", "FLT-2"), sql=f"""
WITH q AS (
  SELECT doc_id, text AS question, source AS context, ' ' || lang || ' ' AS long_answer,
         CASE WHEN n_chars > 2000 THEN ' Yes' WHEN n_chars > 500 THEN 'no ' ELSE 'maybe' END
           AS final_decision
  FROM documents)
SELECT doc_id,
  'Question: ' || question || {NL} || 'Context: ' || context || {NL} || 'Answer: ' || long_answer
    || {NL} || 'Final decision:' AS prompt,
  lower(final_decision) AS completion,
  'Question: ' || question || {NL} || 'Context: ' || context || {NL} || 'Answer: ' AS task_prompt,
  trim(long_answer, {WS_SQL}) || {NL} || 'Final decision: ' || lower(trim(final_decision, {WS_SQL}))
    || '</s>' AS task_completion
FROM q
WHERE lower(trim(final_decision, {WS_SQL})) IN ('yes', 'no')
  AND question IS NOT NULL AND question <> '' AND context IS NOT NULL AND context <> ''""")
def q_qa_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = d.select("doc_id", F.col("text").alias("question"), F.col("source").alias("context"),
                 F.concat(F.lit(" "), F.col("lang"), F.lit(" ")).alias("long_answer"),
                 F.when(F.col("n_chars") > 2000, " Yes").when(F.col("n_chars") > 500, "no ")
                 .otherwise("maybe").alias("final_decision"))
    q = S.complete_rows(S.class_filter(q, "final_decision"), ["question", "context"])
    a = S.qa_training_prompt(q)
    b = S.two_task_prompt(q).select("doc_id", F.col("prompt").alias("task_prompt"),
                                    F.col("completion").alias("task_completion"))
    return a.select("doc_id", "prompt", "completion").join(b, "doc_id")


@register("decision_extract", operators=("FN-15", "FN-16", "FN-17", "PRJ-8", "AGG-27"), sql="WITH "
          + PAIRS_SQL + f""",
o AS (
  SELECT conv_id, turn, prompt, prompt || {NL} || 'Answer: ' || completion AS output_text,
         CASE WHEN length(prompt) % 2 = 0 THEN 'yes' ELSE 'no' END AS final_decision
  FROM pairs),
a AS (
  SELECT conv_id, turn, final_decision,
         trim(string_split(replace(output_text, prompt, ''), 'Answer:')[-1], {WS_SQL}) AS prediction
  FROM o)
SELECT conv_id, turn, prediction, final_decision AS ground_truth,
  CASE WHEN contains(lower(prediction), 'yes') THEN 'yes' ELSE 'no' END AS predicted_decision,
  contains(lower(prediction), lower('the')) AS contains_gold
FROM a""")
def q_decision_extract(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    o = pairs.select("conv_id", "turn", "prompt",
                     F.concat("prompt", F.lit("\nAnswer: "), "completion").alias("output_text"),
                     F.when(F.length("prompt") % 2 == 0, "yes").otherwise("no")
                     .alias("final_decision"))
    pred = T.strip(T.after_last(T.strip_prompt("output_text", "prompt"), "Answer:"))
    a = o.select("conv_id", "turn", pred.alias("prediction"),
                 F.col("final_decision").alias("ground_truth"))
    return a.select("conv_id", "turn", "prediction", "ground_truth",
                    T.decision("prediction").alias("predicted_decision"),
                    T.contains_ci("prediction", F.lit("the")).alias("contains_gold"))

