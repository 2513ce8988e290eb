"""Order of the quality rules: measured costs, what stopping early saves, and verdicts that don't depend on it."""

import itertools

from pyspark.sql import functions as F

from tierlink.llm import quality_rules as Q
from tierlink.session import materialize

TEXTS = [
    "plain words of a text that is long enough to be kept as it stands here",
    "go go go go on on on on and and so on to the end of it all now",
    "\n".join(f"row {i % 2} of the same two lines again" for i in range(4)) + "\nand a tail of its own here",
    "LOUD BIG CAPS ALL OVER THE PLACE FOR EVERY READER TO SEE NOW",
    "a# b# c# d# e# f# g# h# i# j# k# l#",
    "wow!! no!! yes!! oh!! my!! so!! it!! is!! ok!! by!! me!! too!!",
    "too short",
    None,
    "",
]


def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string")


def test_costs_are_measured_on_the_sample(spark):
    stored = materialize(Q.base_columns(table(spark), "text"))
    heavy = Q.Rule("heavy", "aggregate(sequence(1, 300000), 0D, (a, x) -> a + sin(x + n_words)) > 1e9")
    seconds = Q.rule_seconds(stored, (*Q.RULES, heavy))
    assert seconds["heavy"] == max(seconds.values()) > min(seconds.values()) >= Q.LEAST_SECONDS


def test_order_is_by_rejection_per_cost(spark):
    stored = materialize(Q.base_columns(table(spark), "text"))
    rules = (Q.Rule("a", "n_words > 0"), Q.Rule("b", "n_words > 11"), Q.Rule("c", "n_words > 11"), Q.Rule("d", "n_words > 1000"))
    cost = {"a": 16.0, "b": 1.0, "c": 1.0, "d": 1.0}
    assert [r.name for r in Q.order_rules(stored, rules, cost)] == ["b", "c", "a", "d"]
    saved = {o: Q.work_saved(stored, list(o), cost) for o in itertools.permutations(rules)}
    assert all(0 <= x <= 1 for x in saved.values())
    # plain count of the work of one order
    order, work, rows = Q.order_rules(stored, rules, cost), 0.0, stored.collect()
    for r in rows:
        if r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]:
            continue
        for rule in order:
            work += cost[rule.name]
            if {"a": r["n_words"] > 0, "b": r["n_words"] > 11, "c": r["n_words"] > 11, "d": False}[rule.name]:
                break
    assert abs(Q.work_saved(stored, order, cost) - (1 - work / (19.0 * len(rows)))) < 1e-9


def test_no_order_changes_what_is_kept(spark, monkeypatch):
    docs = table(spark)
    kept = lambda: sorted(r["doc_id"] for r in Q.quality_rules(docs).where("kept").collect())
    want = kept()
    assert want and len(want) < docs.count()
    for order in (Q.RULES, Q.RULES[::-1]):
        monkeypatch.setattr(Q, "order_rules", lambda *_, order=order: list(order))
        assert kept() == want


def test_empty_sample(spark):
    empty = table(spark).where(F.lit(False))
    assert Q.quality_rules(empty).collect() == []
    stored = materialize(Q.base_columns(empty, "text"))
    assert {r.name for r in Q.order_rules(stored)} == {r.name for r in Q.RULES}
