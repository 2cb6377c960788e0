"""Sample normalisation and templating (PRJ-1..12, PRJ-15..18, SET-1..3,
FLT-1..4, FLT-14).

A normalised sample is ``(sample_id, text, full_prompt, source, label,
real_answer)``.  Templates are column expressions; the source dispatch is a
``CASE`` with ``raise_error`` for an unknown source, so a bad row fails the
job instead of being silently mis-templated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import GOLD_NUMBER_RE, strip
from quarry.operators.indexing import dense_index, distinct_codes


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _s(x) -> Column:
    """A field rendered the way a Python f-string renders a missing key: ''."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


# Section headers of the reference templates.
Q = "[Question]\n"
CTX = "[Context]\n"
OPTS = "\n\n[Answer Options]\n"
DEC = "\n\n[Final Decision]\n"
ANS = "[Answer]\n"
KNOWN_SOURCES = ("trivia_qa", "pubmedqa", "gsm8k", "lex_glue")


def format_samples(df: DataFrame, source, question="question", answer="answer",
                   context="context", long_answer="long_answer",
                   final_decision="final_decision", endings="endings",
                   label="label") -> DataFrame:
    """PRJ-1: source-dispatched template -> normalised sample columns.

    ``source`` is a column (per-row dispatch) or a literal string.  Columns
    that a source does not use may be absent from ``df`` only if that source
    never occurs; pass ``F.lit(None)`` for them otherwise.
    """
    cols = set(df.columns)

    def get(name):
        if isinstance(name, Column):
            return name
        return F.col(name) if name in cols else F.lit(None).cast("string")

    src = F.lit(source) if isinstance(source, str) and source not in cols else _c(source)
    gold = F.regexp_extract(strip(_s(get(answer))), GOLD_NUMBER_RE, 1)
    text = (F.when(src == "lex_glue", F.concat(F.lit(CTX), _s(get(context))))
            .when(src.isin(*KNOWN_SOURCES), F.concat(F.lit(Q), _s(get(question)))))
    prompt = (
        F.when(src == "trivia_qa",
               F.concat(F.lit("[Context]\n\n[Answer]\n"), _s(get(answer))))
        .when(src == "pubmedqa",
              F.concat(F.lit(CTX), _s(get(context)), F.lit(OPTS), _s(get(long_answer)),
                       F.lit(DEC), _s(get(final_decision))))
        .when(src == "gsm8k",
              F.concat(F.lit(" [Answer]\n"), _s(get(answer)), F.lit(" \n The final answer is: "),
                       gold))
        .when(src == "lex_glue",
              F.concat(F.lit("[Answer Options]\n"), _s(get(endings)), F.lit(DEC), _s(get(label))))
    )
    lab = F.when(src == "trivia_qa", F.lit(0)).when(src.isin(*KNOWN_SOURCES), F.lit(1))
    real = (F.when(src == "trivia_qa", _s(get(answer)))
            .when(src == "pubmedqa", _s(get(final_decision)))
            .when(src == "gsm8k", gold)
            .when(src == "lex_glue", _s(get(label))))
    checked = F.when(src.isin(*KNOWN_SOURCES), src).otherwise(
        F.raise_error(F.concat(F.lit("Unknown source: "), F.coalesce(src, F.lit("null")))))
    return df.select(
        *[c for c in ("sample_id",) if c in cols],
        text.alias("text"), prompt.alias("full_prompt"), checked.alias("source"),
        lab.alias("label"), real.alias("real_answer"))


def format_json_samples(df: DataFrame, prompt="prompt", completion="completion",
                        label="label", source: str = "gsm8k") -> DataFrame:
    """PRJ-2: prompt/completion records; label forced to 1."""
    cols = set(df.columns)
    return df.select(
        *[c for c in ("sample_id",) if c in cols],
        F.concat(F.lit(Q), _s(prompt)).alias("text"),
        F.concat(F.lit(ANS), _s(completion)).alias("full_prompt"),
        F.lit(1).alias("label"), F.lit(source).alias("source"),
        _s(label).alias("real_answer"))


def union_samples(*dfs: DataFrame) -> DataFrame:
    """SET-1: union by column name, nulls for missing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def options_block(endings) -> Column:
    """PRJ-3: ``"{i}. {option}\\n"`` for every option, concatenated."""
    return F.array_join(
        F.transform(_c(endings), lambda x, i: F.concat(i.cast("string"), F.lit(". "), x,
                                                       F.lit("\n"))), "")


# The case-law instruction line.
CHOICE_INSTRUCTION = ("Given the following legal context and options, choose the most "
                      "appropriate option.\n\n")


def multi_choice_prompt(df: DataFrame, context="context", endings="endings",
                        label="label") -> DataFrame:
    """PRJ-3 + FLT-3 + PRJ-11: keep rows whose label indexes an option; the
    prompt is instruction, ``Context:`` (stripped, newlines to spaces),
    enumerated ``Options:`` and ``Answer:``; the completion is the label."""
    ok = F.col(label).isNotNull() & (F.col(label) >= 0) & (F.col(label) < F.size(endings))
    return df.filter(ok).withColumn(
        "prompt",
        F.concat(F.lit(CHOICE_INSTRUCTION), F.lit("Context: "),
                 F.replace(strip(context), F.lit("\n"), F.lit(" ")),
                 F.lit("\n\nOptions:\n"), options_block(endings), F.lit("\nAnswer:"))
    ).withColumn("completion", F.col(label).cast("string"))


def qa_training_prompt(df: DataFrame, question="question", context="context",
                       long_answer="long_answer", final_decision="final_decision") -> DataFrame:
    """PRJ-4: prompt ends in ``Final decision:``; completion = lower decision."""
    return df.withColumn(
        "prompt", F.concat(F.lit("Question: "), _s(question), F.lit("\nContext: "), _s(context),
                           F.lit("\nAnswer: "), _s(long_answer), F.lit("\nFinal decision:"))
    ).withColumn("completion", F.lower(_s(final_decision)))


def two_task_prompt(df: DataFrame, question="question", context="context",
                    long_answer="long_answer", final_decision="final_decision",
                    eos: str = "</s>") -> DataFrame:
    """PRJ-5: completion = stripped long answer, ``Final decision: <d>`` and
    the end-of-sequence marker (a parameter)."""
    return df.withColumn(
        "prompt", F.concat(F.lit("Question: "), _s(question), F.lit("\nContext: "), _s(context),
                           F.lit("\nAnswer: "))
    ).withColumn(
        "completion", F.concat(strip(_s(long_answer)), F.lit("\nFinal decision: "),
                               F.lower(strip(_s(final_decision))), F.lit(eos)))


def train_val_text(df: DataFrame, split="split") -> DataFrame:
    """PRJ-7: training text carries the answer, validation text withholds it."""
    base = F.concat(_s("text"), F.lit("\n"))
    train = F.concat(base, F.lit("Prompt"), _s("full_prompt"), F.lit("\nAnswer:\n "),
                     _s("real_answer"))
    val = F.concat(base, _s("full_prompt"), F.lit("\nAnswer:\n"))
    return df.withColumn("model_text", F.when(F.col(split) == "train", train).otherwise(val))


def class_filter(df: DataFrame, col: str, classes=("yes", "no")) -> DataFrame:
    """FLT-1: ``lower(trim(c)) in classes``."""
    return df.filter(F.lower(strip(col)).isin(*classes))


def complete_rows(df: DataFrame, cols) -> DataFrame:
    """FLT-2: every listed field present and non-empty."""
    cond = reduce(lambda a, b: a & b,
                  [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in cols])
    return df.filter(cond)


def label_encode(df: DataFrame, col: str, out: str = "label_id") -> DataFrame:
    """PRJ-16: sorted distinct values -> 0..k-1, computed on the distinct
    values with a distributed index and joined back on the value."""
    return distinct_codes(df, col, out)


def sample_ids(df: DataFrame, key: str, out: str = "global_index") -> DataFrame:
    """PRJ-12: reproducible 0-based position by a natural key (never
    ``monotonically_increasing_id``), plus ``uid = sample_<i>``."""
    return dense_index(df, key, out).withColumn(
        "uid", F.concat(F.lit("sample_"), F.col(out).cast("string")))


def as_virtual_cluster(df: DataFrame, label: str = "all_samples") -> DataFrame:
    """PRJ-18: the whole dataset as one cluster (id -1)."""
    return df.withColumn("cluster_id", F.lit(-1).cast("long")).withColumn(
        "cluster_label", F.lit(label))
