"""Worked examples of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tierlink.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: T.normalize_phrase(F.lit("Foo-Bar, Inc.")), "foo bar  inc"),
        (lambda: T.normalize_phrase(F.lit(None).cast("string")), ""),
        (lambda: T.normalize_entity(F.lit("Foo-Bar, Inc.")), "foo bar inc"),
        (lambda: T.alnum_len(F.lit("a-1_b")), 3),
        (lambda: T.answer_from_response(F.lit("x Answer: a\nb Answer: c")), "c"),
        (lambda: T.em_answer(F.lit(""), F.lit("x Answer: a\nb Answer: c")), "a\nb"),
        (lambda: T.rouge_answer(F.lit(""), F.lit("x Final short answer: y  z\nrest")), "y z"),
        (lambda: T.normalize_answer(F.lit("The U.S.A., an ally")), "usa ally"),
        (lambda: T.judge_choice(F.lit('{"choice": "B"}')), "B"),
        (lambda: T.judge_choice(F.lit("I pick A.")), "A"),
        (lambda: T.answer_letter(F.lit("(c).")), "C"),
        (lambda: T.answer_letter(F.lit("a banana")), "A"),
        (lambda: T.final_letter(F.lit("because\nFinal answer: (d)")), "D"),
        (lambda: T.final_letter(F.lit("because\n(b)\n")), "B"),
        (lambda: T.index_letter(F.lit(4)), "E"),
        (lambda: T.index_letter(F.lit(9)), ""),
        (lambda: T.extract_json(F.lit('say {"a": {"b": 1}} end')), '{"a": {"b": 1}}'),
        (lambda: T.extract_json(F.lit("say {a b} end")), ""),
        (lambda: T.unquote(F.lit(' "a b" ')), "a b"),
        (lambda: T.grade_bucket(F.lit("Grade 7")), "G7-12"),
        (lambda: T.grade_bucket(F.lit("x")), "UNKNOWN"),
        (lambda: T.model_label(F.lit("label 5.")), "5"),
        (lambda: T.to_bool(F.lit(" Yes ")), True),
        (lambda: T.clean_list(F.array(F.lit(" a"), F.lit(" "), F.lit("a"), F.lit("b"))), ["a", "b"]),
        (lambda: T.entity_list(F.lit('x {"named_entities": ["A-b", "C"]}')), ["a b", "c"]),
        (lambda: T.safe_float(F.lit("x"), 2.0), 2.0),
        (lambda: T.nonnegative_int(F.lit("-3.7")), 0),
    ],
)
def test_examples(spark, make, want):
    assert value(spark, make()) == want


@pytest.mark.parametrize(("name", "want"), [("new york city", 1.0), ("new york", 0.9), ("washington", 0.6), ("oslo", 0.25)])
def test_anchor_weight(spark, name, want):
    assert float(value(spark, T.anchor_weight(F.lit(name)))) == want


@pytest.mark.parametrize(("pred", "gold", "want"), [("the cat sat", "cat sat down", (0.8, 1.0, 2 / 3)), ("yes", "yes indeed", (0.0, 0.0, 0.0)), ("", "x", (0.0, 0.0, 0.0))])
def test_token_f1(spark, pred, gold, want):
    assert tuple(value(spark, T.token_f1(F.lit(pred), F.lit(gold)))) == pytest.approx(want)


def test_model_label_without_label_is_an_error(spark):
    with pytest.raises(Exception, match="no label"):
        value(spark, T.model_label(F.lit("none")))


def test_edge_order_is_depth_first_by_degree():
    from tierlink.operators.pattern import edge_order

    edges = [("a", "r1", "hub"), ("hub", "r2", "b"), ("hub", "r3", "d"), ("b", "r4", "c")]
    assert edge_order(edges, "a") == [("a", "r1", "hub"), ("hub", "r2", "b"), ("b", "r4", "c"), ("hub", "r3", "d")]
