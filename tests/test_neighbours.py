"""Nearest-neighbour joins against brute force, their recall, and linking by the embedding hook."""

import random

import numpy as np
import pytest

from tierlink.functions import hooks
from tierlink.operators import neighbours as N
from tierlink.plans import pipelines


def vectors(n, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims)) * 2
    return centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims))


def frame(spark, x, name="name"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} int, v array<double>").repartition(4)


def brute(q, x, k, metric):
    if metric == "cosine":
        q, x = N.unit(q), N.unit(x)
        s = q @ x.T
    else:
        s = -((q[:, None] - x[None]) ** 2).sum(2)
    return {(i, int(j)): r + 1 for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:k])}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_all_cells_equal_brute_force(spark, metric):
    x, q = vectors(300), vectors(70, seed=2)
    x[10:60] = x[10]  # copies: ties and a cell of many rows
    x[5] = 0
    got = N.knn_join(frame(spark, q, "q"), frame(spark, x), 5, metric, recall=None, per_cell=20, block=16).collect()
    assert {(r["q"], r["name"]): r["rank"] for r in got} == brute(q, x, 5, metric)


def test_halo_reaches_its_recall(spark):
    x = vectors(1500)
    index = frame(spark, x)
    found = N.knn_join(index.withColumnRenamed("name", "q"), index, 8, recall=0.95, per_cell=40, block=128)
    row = N.measured_recall(index.withColumnRenamed("name", "q"), index, found, 8).first()
    assert row["n"] == 256 and row["recall"] >= 0.9
    assert found.select("q").distinct().count() == 1500


def test_few_rows_nulls_and_nothing(spark):
    x = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, 0.0])], "name int, v array<double>")
    q = x.withColumnRenamed("name", "q")
    got = {(r["q"], r["name"]) for r in N.knn_join(q, x, 5).collect()}
    assert got == {(a, b) for a in (1, 3) for b in (1, 3)}
    assert N.knn_join(q, x.where("false"), 5).count() == 0 and N.knn_join(q.where("false"), x, 5).count() == 0
    wrong = spark.createDataFrame([(1, [0.0, 1.0, 2.0])], "q int, v array<double>")
    with pytest.raises(Exception, match="vectors of"):
        N.knn_join(wrong, x, 5).collect()


def test_linking_and_synonyms(spark):
    rng = random.Random(3)
    known = {n: [rng.gauss(0, 1) for _ in range(5)] for n in ("ada", "grace", "alan", "linus")}
    known |= {"ada l": [v + 0.01 for v in known["ada"]], "gracie": [v + 0.01 for v in known["grace"]]}
    old = hooks._KINDS["embed"]
    try:
        hooks.register("embed", lambda t: known[t])
        entities = spark.createDataFrame([("ada",), ("grace",), ("alan",), ("linus",)], "entity string")
        mentions = spark.createDataFrame([("ada",), ("ada l",), ("gracie",), ("ada l",)], "mention string")
        got = {(r["mention"], r["entity"]) for r in pipelines.linked(mentions, entities).collect()}
        assert got == {("ada", "ada"), ("ada l", "ada"), ("gracie", "grace")}
        every = entities.unionByName(mentions.withColumnRenamed("mention", "entity"))
        edges = {(r["head"], r["relation"], r["tail"]) for r in pipelines.synonymy(every, 0.99, 3).collect()}
        assert edges == {("ada", "equivalent", "ada l"), ("ada l", "equivalent", "ada"), ("grace", "equivalent", "gracie"), ("gracie", "equivalent", "grace")}
    finally:
        hooks._KINDS["embed"] = old


def test_graph_index(spark):
    from tierlink.operators import neighbour_graph as NG

    x = vectors(3000, 8)
    index, queries = frame(spark, x), frame(spark, vectors(40, 8, seed=7), "q")
    graph = NG.build_graph(index, degree=10, rounds=2, per_cell=300)
    out = {}
    for r in graph.collect():
        out[r["a"]] = out.get(r["a"], 0) + 1
        assert r["a"] != r["b"] and np.isclose(r["d"], ((x[r["a"]] - x[r["b"]]) ** 2).sum())
    assert len(out) == 3000 and max(out.values()) <= 20
    found, read = NG.search_graph(queries, index, graph, 5)
    want = set(brute(vectors(40, 8, seed=7), x, 5, "l2"))
    got = {(r["q"], r["name"]) for r in found.collect()}
    assert len(got & want) >= 0.9 * len(want) and read < 0.6 * 40 * 3000
