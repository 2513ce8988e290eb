"""Best rows of streams, and what neighbour joins write and send."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tierlink.operators import closest as C
from tierlink.operators import neighbours as N
from tierlink.operators import vectors as VX
from tests.test_neighbours import brute, frame, vectors


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_stream_equals_brute_force(metric):
    x, q = vectors(2000), vectors(90, seed=4)
    x[100:900] = x[100]  # copies tie, wherever they stand
    q[3] = x[100]
    order = np.random.default_rng(2).permutation(len(x))
    best = C.Closest(q, 7, metric)
    for lo in range(0, len(x), 300):
        best.add(x[order[lo : lo + 300]], order[lo : lo + 300])
    got = {}
    for r in np.lexsort((best.name, -np.round(best.score, 9), best.row)):
        got[int(best.row[r]), int(best.name[r])] = sum(1 for a, _ in got if a == best.row[r]) + 1
    assert got == brute(q, x, 7, metric)


def test_stream_memory_does_not_grow_with_the_rows():
    q = vectors(4000, seed=4)
    tracemalloc.start()
    best = C.Closest(q, 5)
    for lo in range(0, 60000, 10000):
        best.add(vectors(10000, seed=lo), np.arange(lo, lo + 10000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20  # 4,000 x 10,000 scores at once would take 320 MB


def test_exact_join_writes_the_rows_once(spark, monkeypatch):
    """Before, each query was written once a cell: 150 times here."""
    written = []
    monkeypatch.setattr(N, "materialize", lambda df: written.append(df.count()) or df)
    x = frame(spark, vectors(3000))
    assert N.knn_join(x.withColumnRenamed("name", "q"), x, 3, recall=None, per_cell=20, block=64).count() == 9000
    assert max(written) <= 3000


def test_many_blocks_with_halos(spark, monkeypatch):
    """Blocks of near cells, with one cell of more queries than a block holds, find what a cell's queries look into."""
    monkeypatch.setattr(N, "QUERIES", 100)
    monkeypatch.setattr(C, "QUERIES", 100)
    x = vectors(1200)
    x[:260] = x[0]
    index = frame(spark, x)
    queries = index.withColumnRenamed("name", "q")
    centres = VX.fit_cells(index, 40)
    cells = N.placed(index, centres)
    got = {(r["q"], r["name"]): r["rank"] for r in N.in_blocks(queries, cells, 4, "l2", centres, 6).collect()}
    seen, own = N.looked_into(centres, 6)(x), VX.squared_distances(x, centres).argmin(1)
    d = np.where(seen[:, own], ((x[:, None] - x[None]) ** 2).sum(2), np.inf)
    want = {(i, int(j)): r + 1 for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), np.round(d[i], 9)))[:4])}
    assert got == want


def test_cell_search_works_in_products(spark):
    """Before, distances were expressions over arrays, number by number."""
    index = frame(spark, vectors(500))
    queries = frame(spark, vectors(30, seed=5), "q")
    centres = VX.fit_cells(index, 8)
    found = VX.approximate(queries, VX.in_cells(index, centres), centres, 5, 8)
    plan = found._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
    assert {(r["q"], r["name"]): r["rank"] for r in found.collect()} == brute(vectors(30, seed=5), vectors(500), 5, "l2")


def test_neighbours_meet_at_their_edges(spark):
    """All neighbours' neighbours that are near enough, and vectors are sent once an edge: no join has a row a pair with vectors."""
    from tierlink.operators import neighbour_graph as NG

    x = vectors(60)
    rng = np.random.default_rng(1)
    d = lambda a, b: float(((x[a] - x[b]) ** 2).sum())
    graph = {(a, int(b)): d(a, b) for a in range(60) for b in rng.choice([i for i in range(60) if i != a], 3 if a else 2, replace=False)}
    graph |= {(a, 7): d(a, 7) for a in range(40) if a != 7}  # a popular row
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in graph.items()], "a int, b int, d double")
    last, count = {}, {}
    for (a, _), v in graph.items():
        last[a], count[a] = max(last.get(a, 0.0), v), count.get(a, 0) + 1
    bar = {a: last[a] if count[a] >= 3 else float("inf") for a in last}
    want = {(a, c) for a, b in graph for b2, c in graph if b == b2 and a != c and round(d(a, c), 9) <= round(bar[a], 9)}
    found = NG.introduced(edges, edges, frame(spark, x), 3)
    got = {(r["a"], r["b"]): r["d"] for r in found.collect()}
    assert set(got) == want and all(np.isclose(v, d(*k)) for k, v in got.items())


@pytest.mark.parametrize("cells", [1 << 22, 200])
def test_late_interaction_equals_all_pairs(spark, monkeypatch, cells):
    """Phrases of one row and of many, tokens of two rows, ties and rows without a vector; no pair of rows leaves a task."""
    monkeypatch.setattr(C, "CELLS", cells)
    rng = np.random.default_rng(4)
    asked = [(q, t % 3, rng.integers(-3, 4, 4).tolist()) for q in range(7) for t in range(4)]  # token 0 has two rows
    rows = [(n, rng.integers(-3, 4, 4).tolist()) for n in range(60) for _ in range(1 if n % 5 else 40)] + [(60, None)]
    best = {}
    for q, t, v in asked:
        for n, w in rows:
            if w is not None:
                best[q, n, t] = max(best.get((q, n, t), -1e9), float(np.dot(v, w)))
    want = {}
    for q in range(7):
        score = sorted((-sum(best[q, n, t] for t in range(3)), n) for n in range(60))
        want |= {(q, r + 1): (n, -s) for r, (s, n) in enumerate(score[:6])}
    queries = spark.createDataFrame([(q, t, [float(x) for x in v]) for q, t, v in asked], "q long, token int, v array<float>")
    index = spark.createDataFrame([(n, None if v is None else [float(x) for x in v]) for n, v in rows], "name long, v array<float>").repartition(3)
    found = VX.late_interaction(queries, index, 6)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert {(r["q"], r["rank"]): (r["name"], r["score"]) for r in found.collect()} == want
    top = phrases(asked, rows, cells)
    assert top == want


def phrases(asked, rows, cells):
    """The same in one task, rows in batches of 7."""
    at = C.Phrases(np.array([v for *_, v in asked], float), np.array([q for q, *_ in asked]), np.array([t for _, t, _ in asked]), 6)
    own = [r for r in rows if r[1] is not None]
    for lo in range(0, len(own), 7):
        at.add(np.array([v for _, v in own[lo : lo + 7]], float), np.array([n for n, _ in own[lo : lo + 7]]))
    table = at.finish().table(pa.array(at.ids), pa.int64()).to_pylist()
    out = {}
    for q in range(7):
        mine = sorted((-r["score"], r["name"]) for r in table if r["q"] == q)
        out |= {(q, i + 1): (n, -s) for i, (s, n) in enumerate(mine)}
    return out
