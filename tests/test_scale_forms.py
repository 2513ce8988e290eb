"""Containment joins, interval unions and fused selections against plain loops."""

import random

from pyspark.sql import functions as F

from tierlink.operators import metrics as M
from tierlink.operators import rank as R
from tierlink.operators.containment import containing


def test_containment_equals_a_plain_search(spark):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "é", "", "x.y", "\n", "😀z"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (None, "a bb ccc a bb ccc"), (5, docs[5][1]), (62, "word" * 5000)]
    items = []
    for i in range(60):
        t = docs[rng.randrange(60)][1]
        j = rng.randrange(len(t) + 1)
        items.append((i, t[j : j + rng.randrange(30)]))  # cut anywhere, inside words too
    items += [(60, None), (61, ""), (None, "bb ccc"), (62, "dwordwordw"), (63, "absent words are not found here"), (3, items[3][1])]
    got = containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id")
    want = [(d, i) for d, t in docs for i, p in items if t is not None and p is not None and p in t]
    by = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got.collect()), key=by) == sorted(want, key=by)
    assert len(want) > 300


def test_containment_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert containing(docs, none, "doc_id", "item_id").collect() == []
    assert containing(docs.where("false"), spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), "doc_id", "item_id").collect() == []


def test_containment_has_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = containing(docs, items, "doc_id", "item_id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def merged(spans):
    out = []
    for a, b in sorted((a, b) for a, b in spans if a is not None and b is not None and a < b):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_interval_union_equals_a_sweep(spark):
    rng = random.Random(8)
    groups = {"many": [(a := rng.randrange(3000), a + rng.randrange(0, 9)) for _ in range(900)], "one": [(0, 10_000), *[(x, x + 1) for x in range(500)]], "ties": [(1, 2)] * 5 + [(2, 3)] * 4, None: [(1, 4), (6, 7), (3, 5)], "empty": [(4, 4), (7, 2), (None, 3)]}
    df = spark.createDataFrame([(g, a, b) for g, x in groups.items() for a, b in x], "g string, start long, stop long")
    got: dict = {}
    for r in M.interval_union(df, ["g"]).collect():
        got.setdefault(r["g"], []).append((r["start"], r["stop"]))
    assert {g: sorted(x) for g, x in got.items()} == {g: merged(x) for g, x in groups.items() if merged(x)}


def test_fusion_prunes_before_the_exchange(spark):
    rng = random.Random(4)
    rows = [(s, d, rng.randrange(6) / 5, rng.randrange(6) / 5, rng.random() < 0.4) for s in (1, 2) for d in range(80)] + [(3, 0, 0.5, 0.5, True)]
    df = spark.createDataFrame(rows, "sample_id int, doc_id int, text_score double, image_score double, is_image boolean")
    out = R.fuse(df, 9, 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    for s in (1, 2, 3):
        own = [r for r in rows if r[0] == s]
        ends = [(min(r[c] for r in own), max(r[c] for r in own)) for c in (2, 3)]
        scale = lambda x, e: (x - e[0]) / (e[1] - e[0]) if e[1] > e[0] else 0.0
        ranked = sorted(own, key=lambda r: (-round(max(scale(r[2], ends[0]), scale(r[3], ends[1])), 9), r[1]))
        first, images = [], 0
        for r in ranked:
            if not r[4] or images < 2:
                first.append(r[1])
                images += r[4]
        want = (first + [r[1] for r in ranked if r[1] not in first])[:9]
        assert [r["doc_id"] for r in out.where(F.col("sample_id") == s).orderBy("position").collect()] == want
