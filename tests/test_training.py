"""Gradients against finite differences, the fitting loop, and walks by back-pointers against enumeration."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlink.operators import graph, metrics, training, walks

NODES, RELS, DIMS = 6, 2, 2


def tables(spark, seed=3, n_edges=14):
    rng = random.Random(seed)
    edges = [(k, rng.randrange(NODES), rng.randrange(NODES), rng.randrange(RELS), 0.5 + rng.random()) for k in range(n_edges)]
    x = rng_array(rng, NODES, DIMS)
    r = rng_array(rng, RELS, DIMS)
    return edges, x, r


def rng_array(rng, *shape):
    return np.array([rng.uniform(0.2, 1.5) for _ in range(int(np.prod(shape)))]).reshape(shape)


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "edge int, src int, dst int, rel int, w double").repartition(3)


def long(spark, a, key, value):
    rows = [(i, d, float(a[i, d])) for i in range(a.shape[0]) for d in range(a.shape[1])]
    return spark.createDataFrame(rows, f"{key} int, dim int, {value} double")


def layer(edges, x, r, add, mul, boundary=None):
    """(out, reached) in numpy."""
    parts = {}
    for _, s, t, k, w in edges:
        parts.setdefault(t, []).append(w * (r[k] * x[s] if mul == "mul" else r[k] + x[s]))
    if boundary is not None:
        for n in range(len(boundary)):
            parts.setdefault(n, []).append(boundary[n])
    out = np.zeros_like(x)
    for t, m in parts.items():
        out[t] = {"sum": np.sum, "min": np.min, "max": np.max}[add](m, axis=0)
    return out


def differences(f, a, step=1e-6):
    g = np.zeros_like(a)
    for at in np.ndindex(*a.shape):
        up, down = a.copy(), a.copy()
        up[at] += step
        down[at] -= step
        g[at] = (f(up) - f(down)) / (2 * step)
    return g


def found(df, key, shape):
    g = np.zeros(shape)
    for row in df.collect():
        g[(row[key], row["dim"]) if len(shape) == 2 else row[key]] += row["g"]
    return g


@pytest.mark.parametrize(("add", "mul"), list(itertools.product(("sum", "min", "max"), ("mul", "add"))))
def test_layer_gradients_equal_finite_differences(spark, add, mul):
    edges, x, r = tables(spark)
    g = rng_array(random.Random(8), NODES, DIMS) - 0.8
    w = np.array([e[4] for e in edges])

    def loss(w=w, x=x, r=r):
        return float((layer([(*e[:4], v) for e, v in zip(edges, w, strict=True)], x, r, add, mul) * g).sum())

    got = training.spmm_gradients(edge_frame(spark, edges), long(spark, x, "node", "x"), long(spark, r, "rel", "r"), long(spark, g, "node", "g"), add, mul)
    assert np.allclose(found(got["edge"], "edge", w.shape), differences(lambda v: loss(w=v), w), atol=1e-5)
    assert np.allclose(found(got["relation"], "rel", r.shape), differences(lambda v: loss(r=v), r), atol=1e-5)
    assert np.allclose(found(got["state"], "node", x.shape), differences(lambda v: loss(x=v), x), atol=1e-5)


@pytest.mark.parametrize("add", ["sum", "min", "max"])
def test_gradients_through_layers_equal_finite_differences(spark, add):
    edges, x, r = tables(spark, 5)
    r[0] -= 1.0  # some aggregates fall below 0
    top = rng_array(random.Random(4), NODES, DIMS) - 0.5
    layers = 3

    def loss(x=x, r=r, ws=None):
        h = x
        for k in range(layers):
            own = edges if ws is None else [(*e[:4], v) for e, v in zip(edges, ws[k], strict=True)]
            h = h + np.maximum(layer(own, h, r, add, "mul", x), 0)
        return float((h * top).sum())

    frame, boundary, relation = edge_frame(spark, edges), long(spark, x, "node", "x"), long(spark, r, "rel", "r")
    states = training.forward(frame, boundary, relation, layers, add=add)
    assert np.isclose(sum(row["x"] * top[row["node"], row["dim"]] for row in states[-1].collect()), loss())
    got = training.backward(frame, states, boundary, relation, long(spark, top, "node", "g"), add=add)
    assert np.allclose(found(got["relation"], "rel", r.shape), differences(lambda v: loss(r=v), r), atol=1e-4)
    assert np.allclose(found(got["boundary"], "node", x.shape), differences(lambda v: loss(x=v), x), atol=1e-4)
    ws = np.array([[e[4] for e in edges]] * layers)
    by_layer = np.stack([found(df, "edge", (len(edges),)) for df in got["layers"]])
    assert np.allclose(by_layer, differences(lambda v: loss(ws=v), ws), atol=1e-4)


def loss_rows(spark):
    rng = random.Random(6)
    rows = [(q, k, rng.uniform(-3, 3), int(k < q % 3)) for q in range(4) for k in range(6)]
    return rows, lambda values: spark.createDataFrame([(q, k, float(v), t) for (q, k, _, t), v in zip(rows, values, strict=True)], "q int, k int, score double, target int")


@pytest.mark.parametrize("temperature", [0.0, 0.7])
def test_bce_gradient_equals_finite_differences(spark, temperature):
    rows, _ = loss_rows(spark)
    score, target = (np.array([r[i] for r in rows], float).reshape(4, 6) for i in (2, 3))
    w = np.zeros_like(score)
    for q in range(4):
        for t in (0, 1):
            on = target[q] == t
            e = np.exp(score[q, on] / temperature) if temperature and not t else np.ones(on.sum())
            w[q, on] = e / max(e.sum(), 1e-300)

    def loss(s):
        return float(((np.logaddexp(0, s) - target * s) * w).sum(1) @ (1 / w.sum(1)) / 4)

    df = spark.createDataFrame([(int(q), int(k), float(s), int(t)) for q, k, s, t in rows], "q int, k int, score double, target int")
    assert np.isclose(metrics.bce_loss(df, ["q"], temperature).first()["loss"], loss(score))
    got = {(r["q"], r["k"]): r["g"] for r in training.bce_gradient(df, ["q"], temperature).collect()}
    want = differences(loss, score)
    assert all(abs(got[q, k] - want[q, k]) < 1e-6 for q in range(4) for k in range(6))


def test_list_ce_gradient_equals_finite_differences(spark):
    rows, _ = loss_rows(spark)
    score, target = (np.array([r[i] for r in rows], float).reshape(4, 6) for i in (2, 3))

    def loss(s):
        p = 1 / (1 + np.exp(-s))
        each = -np.log(p / (p.sum(1, keepdims=True) + 1e-5) + 1e-5) * target
        on = target.sum(1) > 0
        return float((each[on].sum(1) / target[on].sum(1)).mean())

    df = spark.createDataFrame([(int(q), int(k), float(s), int(t)) for q, k, s, t in rows], "q int, k int, score double, target int")
    assert np.isclose(metrics.list_ce_loss(df, ["q"]).first()["loss"], loss(score))
    got = {(r["q"], r["k"]): r["g"] for r in training.list_ce_gradient(df, ["q"]).collect()}
    want = differences(loss, score)
    assert all(abs(got[q, k] - want[q, k]) < 1e-6 for q in range(4) for k in range(6))


def test_adam_equals_its_formula(spark):
    params = spark.createDataFrame([("a", "x", 0, 1.0, 0.0, 0.0), ("b", "x", 0, 2.0, 0.1, 0.2)], "name string, key string, dim int, value double, first double, second double")
    grads = spark.createDataFrame([("a", "x", 0, 0.5)], "name string, key string, dim int, g double")
    got = {r["name"]: r for r in training.adam(params, grads, 3, rate=0.1).collect()}
    for name, value, m, v, g in (("a", 1.0, 0.0, 0.0, 0.5), ("b", 2.0, 0.1, 0.2, 0.0)):
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want = value - 0.1 * (m / (1 - 0.9**3)) / (np.sqrt(v / (1 - 0.999**3)) + 1e-8)
        assert np.isclose(got[name]["value"], want) and np.isclose(got[name]["first"], m) and np.isclose(got[name]["second"], v)


def links_of(spark):
    """Two kinds of heads with a relation each to a kind of their own, so that there is something to learn."""
    rows = [(i, f"u{i}", "likes", f"p{i % 3}") for i in range(9)]
    near = [(f"u{i}", "near", f"u{(i + 3) % 9}") for i in range(9)]
    links = spark.createDataFrame(rows, "q int, head string, rel string, tail string")
    both = [(h, r, t) for _, h, r, t in rows] + near
    both += [(t, f"inv {r}", h) for h, r, t in both]
    edges = spark.createDataFrame([(i, h, t, r, 1.0) for i, (h, r, t) in enumerate(both)], "edge int, src string, dst string, rel string, w double")
    nodes = spark.createDataFrame([(f"p{i}",) for i in range(3)], "node string")
    return edges, links, nodes


def test_fit_falls_repeats_and_resumes(spark, tmp_path):
    edges, links, nodes = links_of(spark)
    options = {"dims": 3, "layers": 2, "negatives": 2, "rate": 0.1, "batches": 2}
    params, losses = training.fit(edges.repartition(4), links, nodes, f"{tmp_path}/a", steps=3, **options)
    falling = [r["loss"] for r in losses.orderBy("step").collect()]
    assert len(falling) == 3 and falling[2] < falling[0]  # the third step has the first one's batch
    training.fit(edges.repartition(2), links.repartition(3), nodes, f"{tmp_path}/b", steps=1, **options)
    again, later = training.fit(edges, links, nodes, f"{tmp_path}/b", steps=3, **options)  # goes on behind step 1
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, params.collect()))
    assert [r["loss"] for r in later.orderBy("step").collect()] == falling
    training.save_bundle(params, {"dims": 3, "layers": 2}, f"{tmp_path}/bundle")
    loaded, config = training.load_bundle(spark, f"{tmp_path}/bundle")
    assert config == {"dims": 3, "layers": 2} and sorted(map(tuple, loaded.collect())) == sorted(map(tuple, params.collect()))


def test_model_gradients_equal_finite_differences(spark):
    """All parameters of the link model, over a batch whose queries share the graph."""
    edges, links, _ = links_of(spark)
    batch = links.where("q in (0, 4)").select("q", "head", "rel", F.col("tail").alias("node"))
    rows = [(0, "p0", 1), (0, "p1", 0), (4, "p1", 1), (4, "p2", 0), (4, "nowhere", 0)]
    candidates = spark.createDataFrame(rows, "q int, node string, target int")
    params = training.initial(edges, 2)
    values = [tuple(r) for r in params.orderBy("name", "key", "dim").collect()]

    def loss(vector):
        own = spark.createDataFrame([(n, k, d, float(v), 0.0, 0.0) for (n, k, d, *_), v in zip(values, vector, strict=True)], params.schema)
        return metrics.bce_loss(training.scored(edges, own, batch, candidates, 1)[0], ["q"]).first()["loss"]

    scored, boundary, states = training.scored(edges, params, batch, candidates, 1)
    got = {(r["name"], r["key"], r["dim"]): r["g"] for r in training.gradients(edges, params, batch, training.bce_gradient(scored, ["q"]), boundary, states).collect()}
    start = np.array([v[3] for v in values])
    for i in (0, 3, 7, len(values) - 1):
        up, down = start.copy(), start.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs(got.get(values[i][:3], 0.0) - (loss(up) - loss(down)) / 2e-4) < 1e-5, values[i]


def test_draw_negatives(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(10)], "node string")
    edges = spark.createDataFrame([("a", "r", f"n{i}") for i in range(9)] + [("b", "r", "n0")], "head string, relation string, tail string")
    batch = spark.createDataFrame([(1, "a", "r"), (2, "b", "r"), (3, "a", "other")], "q int, head string, relation string")
    got = graph.draw_negatives(batch, edges, nodes, 40).collect()
    assert len(got) == 120 and len({(r["q"], r["draw"]) for r in got}) == 120
    assert {r["candidate"] for r in got if r["q"] == 1} == {"n9"} and "n0" not in {r["candidate"] for r in got if r["q"] == 2}
    assert len({r["candidate"] for r in got if r["q"] == 3}) > 5
    full = edges.unionByName(spark.createDataFrame([("a", "r", "n9")], edges.schema))
    with pytest.raises(ValueError, match="no negative"):
        graph.draw_negatives(batch, full, nodes, 2, rounds=5)


def test_gradient_walks_equal_enumeration(spark):
    rng = random.Random(12)
    edges = [(k, rng.randrange(7), rng.randrange(7), rng.randrange(2), 1.0) for k in range(22)]
    by_layer = [[(t, k, rng.uniform(-1, 2)) for t in (5, 6) for k in range(22) if layer < 2 or rng.random() < 0.8] for layer in range(3)]
    frames = [spark.createDataFrame(g, "t int, edge int, g double") for g in by_layer]
    sources, targets = [0, 1], [5, 6]
    made = walks.gradient_walks(edge_frame(spark, edges), frames, spark.createDataFrame([(s,) for s in sources], "node int"), spark.createDataFrame([(t,) for t in targets], "t int"), beam=40)
    got = {(r["t"], r["place"]): (round(r["mean"], 9), [(h["head"], h["rel"], h["tail"]) for h in r["path"]]) for r in walks.average_length(made, 6).collect()}
    want = {}
    for t in targets:
        value = [{k: g for u, k, g in layer if u == t} for layer in by_layer]
        every, front = [], [(s, 0.0, []) for s in sources]
        for i in range(3):
            front = [(d, score + value[i].get(k, 0.0), [*path, (str(s), str(r), str(d))]) for n, score, path in front for k, s, d, r, _ in edges if s == n and n != t]
            every += [(score / (i + 1), i, path) for n, score, path in front if n == t]
        every.sort(key=lambda e: -e[0])
        want |= {(t, p + 1): (round(m, 9), path) for p, (m, _, path) in enumerate(every[:6])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert sum(got[k][1] == want[k][1] for k in want) >= len(want) - 2  # parallel edges of equal gradient may trade places


def test_walks_from_one_beam_entry_of_equal_scores(spark):
    """Entries of a node with close scores go on once."""
    edges = spark.createDataFrame([(0, 0, 2, 0), (1, 1, 2, 0), (2, 2, 3, 0)], "edge int, src int, dst int, rel int")
    flat = spark.createDataFrame([(3, 0, 1.0), (3, 1, 1.0 + 1e-9), (3, 2, 1.0)], "t int, edge int, g double")
    made = walks.gradient_walks(edges, [flat, flat], spark.createDataFrame([(0,), (1,)], "node int"), spark.createDataFrame([(3,)], "t int"), 5)
    assert len(walks.average_length(made, 5).collect()) == 1


def test_flow_walks_equal_walks_with_paths(spark):
    rng = random.Random(2)
    flows = spark.createDataFrame([(layer, rng.randrange(6), rng.randrange(6), rng.randrange(3), -rng.random()) for layer in range(4) for _ in range(25)], "layer int, src int, dst int, rel int, log_flow double")
    prior = spark.createDataFrame([(n, -rng.random()) for n in range(3)], "node int, log_mass double")
    targets = spark.createDataFrame([(1,), (4,)], "node int")
    a = {(r["node"], r["rank"] + 1): (round(r["score"], 9), [tuple(h) for h in r["path"]]) for r in walks.flow_walks(flows, prior, 4, 3, targets).collect()}
    b = {(r["node"], r["rank"]): (round(r["score"], 9), [tuple(h) for h in r["path"]]) for r in graph.viterbi(flows, prior, 4, 3, targets).collect()}
    assert a == b


def test_close_walks_all_count_without_apart(spark):
    """Walks whose scores differ by less than 1e-5 of themselves are different walks to the SQL; the operator's rule would drop all but the first."""
    edges = [(f"a{i}", "r", "m", 1.0 + i * 1e-6) for i in range(4)] + [("m", "r", "t", 0.5)]
    frame = spark.createDataFrame([(f"{a}{b}", a, b, r) for a, r, b, _ in edges], "edge string, src string, dst string, rel string")
    layer = spark.createDataFrame([("t", f"{a}{b}", g) for a, _, b, g in edges], "t string, edge string, g double")
    sources = spark.createDataFrame([(f"a{i}",) for i in range(4)], "node string")
    targets = spark.createDataFrame([("t",)], "t string")
    count = lambda apart: walks.gradient_walks(frame, [layer, layer], sources, targets, 10, apart)[1].where("node = 't'").count()
    assert (count(True), count(False)) == (1, 4)


def test_states_of_heads_alike_are_worked_out_once(spark):
    """Rows of states follow the kinds of nodes and heads, not their product, and scores are those of the graph as it is."""
    pairs = [(f"u{i}", "in", f"n{i % 2}") for i in range(40)] + [(f"u{i}", "is", f"s{i % 3}") for i in range(8, 40)]
    pairs += [(t, f"inv {r}", h) for h, r, t in pairs] + [("u1", "in", "n0"), ("u1", "knows", "u3"), ("u5", "knows", "u5")]
    edges = spark.createDataFrame([(i, h, t, r, 0.5) for i, (h, r, t) in enumerate(pairs)], "edge int, src string, dst string, rel string, w double")
    batch = spark.createDataFrame([(i, f"u{i}", "is") for i in range(30)] + [(30, "outside", "is")], "q int, head string, rel string")
    params = training.initial(edges, 2)
    candidates = batch.select("q").join(spark.createDataFrame([(n,) for n in ("s0", "s1", "n0", "u0", "u2", "u3", "u5", "outside")], "node string")).withColumn("target", F.lit(0))
    rows, _, states = training.scored(edges, params, batch, candidates, 3)
    assert states[-1].count() < 400  # 2,600 of all queries at all nodes
    boundary = batch.join(training.array_of(params, "query", "rel", "x"), "rel").select("q", F.col("head").alias("node"), "dim", "x")
    plain = training.forward(edges, boundary, training.array_of(params, "relation", "rel", "r"), 3, ["q"])[-1]
    out = {r["dim"]: r["o"] for r in training.array_of(params, "out", "__all", "o").collect()}
    want = {}
    for r in plain.collect():
        want[r["q"], r["node"]] = want.get((r["q"], r["node"]), 0.0) + r["x"] * out[r["dim"]]
    got = {(r["q"], r["node"]): r["score"] for r in rows.collect()}
    assert len(got) == 31 * 8 and all(abs(v - want.get(k, 0.0)) < 1e-9 for k, v in got.items()) and sum(v > 0 for v in got.values()) > 100
