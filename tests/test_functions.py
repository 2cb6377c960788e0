"""Hand-made rows (FIXTURES.md section 5) for the scalar functions."""

import math

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys()))
    return df.select(expr.alias("x")).first()["x"]


def test_keywords(spark):
    got = one(spark, T.keywords("t"), t="The quick, Hello hello élan x1yz this")
    assert got == ["hello", "élan"]


def test_final_answer(spark):
    assert one(spark, T.final_answer_number("t"), t="so ... Final answer is: 12.5") == 12


def test_final_answer_fallback(spark):
    assert one(spark, T.final_answer_number("t"), t="a 3\nb 7 8\nend") == 7


def test_final_answer_two_lines(spark):
    assert one(spark, T.final_answer_number("t"), t="x\n4") == 4


def test_final_answer_none(spark):
    assert one(spark, T.final_answer_number("t"), t="no digits here") is None


def test_nearest_number(spark):
    assert one(spark, T.nearest_number("t", "l"), t="a 3 b -4.5 c 10", l=9) == 10


def test_nearest_number_tie_first(spark):
    assert one(spark, T.nearest_number("t", "l"), t="8 and 10", l=9) == 8


def test_gold_number(spark):
    assert one(spark, T.gold_number("t"), t="a #### -12") == -12


def test_first_truthy(spark):
    assert one(spark, T.first_truthy("a", "b", "c"), a="", b="x", c="y") == "x"
    assert one(spark, T.first_truthy("a", "b"), a="0", b="x") == "0"  # a string that is not empty
    assert one(spark, T.first_truthy("a", "b", "c"), a=0.0, b=False, c="x") == "x"
    assert one(spark, T.first_truthy("a", "b", "c"), a=0, b=True, c="x") == "true"
    assert one(spark, T.first_truthy("a", "b"), a=0, b="") is None


def test_chunks(spark):
    assert one(spark, T.chunks("t", 3), t="abcdefg") == ["abc", "def", "g"]


def test_structure_tag(spark):
    assert one(spark, T.structure_tag("t"), t="  ") == "unknown"
    assert one(spark, T.structure_tag("t"), t=" PubMed ") == "pubmed"


def test_decision_and_after_last(spark):
    assert one(spark, T.decision(T.after_last("t")), t="Answer: no. Answer: Yes it is") == "yes"


def test_cosine(spark):
    got = one(spark, V.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))),
              z=1)
    assert math.isclose(got, 0.8)
    zero = one(spark, V.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(1.0))),
               z=1)
    assert zero == 0.0


def test_margin(spark):
    assert one(spark, V.logit_margin(F.array(F.lit(3.0), F.lit(9.0), F.lit(7.0))), z=1) == 2.0
    assert one(spark, V.logit_margin(F.array(F.lit(4.0))), z=1) == 4.0
    assert one(spark, V.logit_margin(F.array(F.lit(9.0), F.lit(9.0), F.lit(1.0))), z=1) == 0.0


def test_section_parse(spark):
    p = "Context: the ctx\n\nOptions:\n0. a\n1. b\n\nAnswer:"
    assert one(spark, T.section("t", "Context", ("\n\n", "Options:")), t=p) == "the ctx"


def test_porter_paper_examples():
    from quarry.functions.porter import stem
    cases = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop",
             "filing": "file", "happy": "happi", "relational": "relat", "vietnamization":
             "vietnam", "sensibiliti": "sensibl", "replacement": "replac", "controll": "control",
             "generalizations": "gener", "feed": "feed", "sing": "sing"}
    assert {w: stem(w) for w in cases} == cases


def test_stemmed_rouge(spark):
    from quarry.operators.overlap import score_pairs
    df = spark.createDataFrame([(1, "the runners running", "the runner runs")],
                               ["k", "pred", "gold"])
    plain = score_pairs(df, "k", "pred", "gold", ("rouge1",)).first()["rouge1"]
    stemmed = score_pairs(df, "k", "pred", "gold", ("rouge1", "rougeL"), stem=True).first()
    assert plain < stemmed["rouge1"] and math.isclose(stemmed["rouge1"], 1.0)
    assert math.isclose(stemmed["rougeL"], 1.0)
