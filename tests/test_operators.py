"""Worked examples and properties of the operators, against small Python references."""

import itertools
import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tierlink.operators import build as B
from tierlink.operators import graph as G
from tierlink.operators import metrics as M
from tierlink.operators import pattern as P
from tierlink.operators import rank as R
from tierlink.operators.components import connected_components
from tierlink.sources import encode, readers, sinks
from tierlink.streaming import incremental


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_last_relation_of_a_pair_wins(spark):
    t = spark.createDataFrame([(1, "a", "r1", "b"), (2, "a", "r2", "b")], "seq int, head string, relation string, tail string")
    assert rows(B.last_wins(t), "head", "relation", "tail") == [("a", "r2", "b")]


def test_clean_triples(spark):
    t = spark.createDataFrame([(1, ["A-b", "r", "C"]), (2, ["a"]), (3, ["a", "b"]), (4, ["a", "--", "c"]), (5, None)], "seq int, items array<string>")
    assert rows(B.clean_triples(t), "seq", "status") == [(1, "clean"), (2, "ignored"), (3, "noisy"), (4, "noisy"), (5, "ignored")]


def test_table_rows_become_facts(spark):
    t = spark.createDataFrame([("d", "tb_1", 0, "Obama", "Honolulu", None)], "doc string, t string, r int, person string, birth_place string, x string")
    assert rows(B.unpivot_rows(t, ["doc", "t", "r"], "person", ["birth_place", "x"]), "head", "relation", "tail", "source_ref", "confidence") == [("Obama", "birth_place", "Honolulu", "tb_1#row0", 0.8)]
    lists = spark.createDataFrame([("d", "t", 0, [], ["x", "y"]), ("d", "t", 1, ["a", "b"], ["x", None]), ("d", "t", 2, [], ["z"])], "doc_id string, table_id string, row_id int, headers array<string>, cells array<string>")
    assert rows(B.unpivot_lists(lists), "head", "relation", "tail") == [("t", "has_value", "z"), ("x", "column_1", "y")]


def test_micro_filters(spark):
    f = spark.createDataFrame([("i1", "aa", "r", "bb", "t", "s1", 0.5, "d"), ("i2", "aa", "r", "bb", "t", "s2", 0.9, "d"), ("i3", "a", "r", "bb", "t", "s", 0.9, "d"), ("i4", "cc", "r", "dd", "t", "s", 0.49, "d")], "triple_id string, head string, relation string, tail string, modality string, source_ref string, confidence double, doc_id string")
    assert rows(B.filter_micro(f), "triple_id") == [("i1",)]
    none = spark.createDataFrame([], "triple_id string, entity string")
    p = spark.createDataFrame([("a", 0.69), ("b", 0.70)], "triple_id string, confidence double")
    assert rows(B.prune_unaligned(p, none), "triple_id") == [("b",)]


def test_ranks_and_losses(spark):
    s = spark.createDataFrame([("q", 1, 0.9, 0), ("q", 2, 0.8, 1), ("q", 3, 0.7, 0), ("q", 4, 0.6, 1)], "sample string, id int, score double, target int")
    assert rows(M.filtered_ranks(s, ["sample"], F.col("target") == 1), "id", "filtered") == [(2, 2), (4, 3)]
    p = spark.createDataFrame([("q", 1, 0.8, 1), ("q", 2, 0.9, 0), ("q", 3, 0.8, 0), ("q", 4, 0.7, 0)], "sample string, id int, score double, target int")
    assert rows(M.pessimistic_ranks(p, ["sample"]), "id", "rank") == [(1, 3)]
    answers = spark.createDataFrame([("q", 1, 1), ("q", 3, 3)], "sample string, rank int, filtered int")
    m = M.qa_metrics(answers, ["sample"]).first()
    assert (m["mrr"], m["hits_2"], m["recall_2"]) == pytest.approx(((1 + 1 / 3) / 2, 0.5, 0.5))
    zero = spark.createDataFrame([("a", 1, 1.0, 0), ("b", 1, 0.0, 1), ("b", 2, 0.0, 0)], "sample string, id int, score double, target int")
    assert M.list_ce_loss(zero, ["sample"]).first()["loss"] == pytest.approx(-math.log(0.5 / (1 + 1e-5) + 1e-5))


def test_capped_select_backfills(spark):
    r = spark.createDataFrame([("q", "I1", 1, True), ("q", "I2", 2, True), ("q", "T1", 3, False), ("q", "I3", 4, True)], "s string, id string, rank int, is_image boolean")
    got = sorted((x["position"], x["id"]) for x in R.capped_select(r, ["s"], 3, 1).collect())
    assert got == [(1, "I1"), (2, "T1"), (3, "I2")]

    def walk(items, k, cap):
        out, images = [], 0
        for i, image in items:
            if len(out) == k:
                break
            if image and images >= cap:
                continue
            images += image
            out.append(i)
        return out + [i for i, _ in items if i not in out][: k - len(out)]

    rng = random.Random(5)
    for _ in range(6):
        items = [(f"x{i:02}", rng.random() < 0.5) for i in range(12)]
        df = spark.createDataFrame([("q", i, n, im) for n, (i, im) in enumerate(items)], "s string, id string, rank int, is_image boolean")
        cap, k = rng.randrange(4), rng.randrange(1, 10)
        assert [x["id"] for x in R.capped_select(df, ["s"], k, cap).orderBy("position").collect()] == walk(items, k, cap)


def test_activation_scores(spark):
    facts = spark.createDataFrame([("t1", "d"), ("t2", "d")], "triple_id string, doc_id string")
    hits = spark.createDataFrame([(1, "t1", 0.0), (1, "t2", 1.0)], "sample_id int, triple_id string, distance double")
    assert rows(R.micro_doc_scores(hits, facts), "doc_id", "score") == [("d", 1.0)]
    near = spark.createDataFrame([(1, "oslo", "n1", 0.0), (1, "oslo", "n2", 1.0), (1, "new york", "n1", 0.0), (1, "far", "n1", 1.5)], "sample_id int, anchor string, node string, distance double")
    incident = spark.createDataFrame([("n1", "t1"), ("n2", "t2")], "node string, triple_id string")
    assert R.anchor_doc_scores(near, incident, facts).first()["score"] == pytest.approx(1.15)
    g, n = (spark.createDataFrame([(1, "d", v)], "sample_id int, doc_id string, score double") for v in (0.5, 0.4))
    assert R.merge_max(g, n, 2.0).first()["score"] == pytest.approx(0.8)


def test_k_smallest_evicts_the_smallest_payload(spark):
    s = spark.createDataFrame([("g", 1.0, "a"), ("g", 1.0, "b")], "g string, score double, payload string")
    assert rows(R.k_smallest(s, ["g"], 1, "score", "payload"), "payload") == [("b",)]


def test_interval_union_and_concat(spark):
    s = spark.createDataFrame([("k", 0, 2), ("k", 1, 3), ("k", 4, 6)], "k string, start int, stop int")
    assert rows(M.interval_union(s, ["k"]), "start", "stop") == [(0, 3), (4, 6)]
    a = spark.createDataFrame([(0, i, i) for i in range(3)] + [(1, i, i) for i in (3, 4)], "g int, value int, pos int")
    b = spark.createDataFrame([(0, -1, 0), (1, -2, 0), (1, -3, 1)], "g int, value int, pos int")
    assert [x["value"] for x in M.variadic_concat(a, b, ["g"]).orderBy("g", "pos").collect()] == [0, 1, 2, -1, 3, 4, -2, -3]


def test_id_alignment(spark):
    test = spark.createDataFrame([(0, "x"), (1, "y")], "pos long, id string")
    got = spark.createDataFrame([("1",), ("x",), ("9",)], "rid string")
    assert dict(rows(R.align_ids(test, got), "rid", "id")) == {"1": "y", "x": "x", "9": None}


def test_path_relations_weights(spark):
    hops = spark.createDataFrame([("s", 1, 0, 2, "a", "b", 0.8), ("s", 1, 1, 2, "b", "c", 0.8)], "sample string, path int, pos int, n_hops int, head string, tail string, score double")
    keys = spark.createDataFrame([("s", "a", "A"), ("s", "b", "B"), ("s", "c", "C")], "sample string, key string, doc string")
    got = {(r["a"], r["b"]): r["score"] for r in R.path_relations(hops, keys).collect()}
    assert got == pytest.approx({("A", "B"): 0.4, ("B", "C"): 0.4, ("A", "C"): 0.16})


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(rows(got, "node", "component")) == want
    empty = connected_components(spark.createDataFrame([], "src long, dst long"))
    assert empty.count() == 0
    eq = spark.createDataFrame([("b", "a"), ("b", "c")], "head string, tail string")
    assert set(dict(rows(G.canonical_names(eq), "name", "canonical")).values()) == {"a"}


def brute_walks(flows, prior, layers):
    walks = [((), n, s) for n, s in prior.items()]
    for layer in range(layers):
        walks = [(p + ((n, r, d),), d, s + f) for p, n, s in walks for (la, src, r, d), f in flows.items() if la == layer and src == n]
    return walks


def test_flow_mass_and_viterbi(spark):
    rng = random.Random(3)
    nodes = "abcdef"
    edges = sorted({(layer, rng.choice(nodes), rng.choice("rs"), rng.choice(nodes)) for layer in range(3) for _ in range(12)})
    m = spark.createDataFrame([(*e, rng.uniform(-1, 2)) for e in edges], "layer int, src string, rel string, dst string, logit double")
    flows = G.local_flow(m).cache()
    total = {(r["layer"], r["dst"]): r["s"] for r in flows.groupBy("layer", "dst").agg(F.sum("flow").alias("s")).collect()}
    assert all(v == pytest.approx(1) for v in total.values())
    prior = G.source_prior(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", -1.0)], "node string, w double"))
    p = dict(rows(prior, "node", "log_mass"))
    f = {(r["layer"], r["src"], r["rel"], r["dst"]): r["log_flow"] for r in flows.collect()}
    walks = brute_walks(f, p, 3)
    mass = defaultdict(float)
    for _, n, s in walks:
        mass[n] += math.exp(s)
    assert {k: math.exp(v) for k, v in rows(G.path_mass(flows, prior, 3), "node", "log_mass")} == pytest.approx(dict(mass))
    got = G.viterbi(flows, prior, 3, 4).collect()
    for n in {w[1] for w in walks}:
        best = sorted((s for _, d, s in walks if d == n), reverse=True)[:4]
        assert [r["score"] for r in sorted((r for r in got if r["node"] == n), key=lambda r: r["rank"])] == pytest.approx(best)
    with pytest.raises(Exception, match="no positive source weight"):
        G.source_prior(spark.createDataFrame([("a", 0.0), ("b", 1.0)], "node string, w double").where("w < 1")).collect() or G.source_prior(spark.createDataFrame([("a", 0.0)], "node string, w double")).agg(F.raise_error(F.lit("no positive source weight"))).collect()


def brute_matches(pattern, facts, nodes, rels):
    """All matches of a connected pattern by enumerating node and edge choices from its root."""
    own = {n for h, _, t in facts for n in (h, t)}
    cand = {q: {n: d for n, d in v.items() if n in own} for q, v in nodes.items()}
    names = list(dict.fromkeys(x for h, _, t in pattern for x in (h, t)))
    root = min((n for n in names if "UNKNOWN" not in n), key=lambda n: len(cand[n]))
    order = P.edge_order(pattern, root)
    for reverse in (False, True):
        adj = {(h, r, t): 0.0 for h, r, t in facts}
        if reverse:
            for h, r, t in facts:
                adj.setdefault((t, r, h), 0.25)
        out = []

        def go(i, bound, score, text, reuse):
            if i == len(order):
                out.append((round(score, 9), reuse, ";".join(text)))
                return
            s, rel, q = order[i]
            for (h, r, t), pen in adj.items():
                if h != bound[s]:
                    continue
                if q in bound:
                    if bound[q] != t:
                        continue
                    nd, gate, again = 0.0, True, False
                elif "UNKNOWN" in q:
                    nd, gate, again = 0.0, True, t in bound.values()
                elif t in cand[q]:
                    nd, again = cand[q][t], t in bound.values()
                    gate = nd <= 0.6
                else:
                    continue
                if "UNKNOWN" not in rel and gate:
                    if r not in rels[rel]:
                        continue
                    rc = rels[rel][r]
                else:
                    rc = 0.0
                go(i + 1, bound | {q: t}, score + nd + rc + pen, [*text, f"{h}>{r}>{t}"], reuse or again)

        for n, d in cand[root].items():
            go(0, {root: n}, d, [], False)
        if out:
            return sorted(out)
    return []


def frames(spark, facts, nodes, rels):
    schema = "q string, name string, distance double"
    return (
        spark.createDataFrame(sorted(facts), "head string, relation string, tail string"),
        spark.createDataFrame([(q, n, d) for q, v in nodes.items() for n, d in v.items()], schema),
        spark.createDataFrame([(q, n, d) for q, v in rels.items() for n, d in v.items()], schema),
    )


@pytest.mark.parametrize("pattern", [[("P", "r", "Q")], [("P", "r", "UNKNOWN1"), ("UNKNOWN1", "s", "Q")], [("P", "r", "Q"), ("Q", "s", "UNKNOWN"), ("UNKNOWN", "r", "P")], [("Q", "UNKNOWN rel", "P")]])
def test_pattern_matching_is_exact(spark, pattern):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(7)]
    facts = {(rng.choice(names), rng.choice("rst"), rng.choice(names)) for _ in range(18)}
    nodes = {"P": {n: round(rng.uniform(0, 1), 2) for n in names[:4]}, "Q": {n: round(rng.uniform(0, 1), 2) for n in names[2:7]}}
    rels = {"r": {"r": 0.0, "s": 0.4}, "s": {"s": 0.0, "t": 0.7}}
    got = P.match_pattern(pattern, *frames(spark, facts, nodes, rels), k=10_000)
    assert sorted((round(r["score"], 9), r["reuse"], r["edges"]) for r in got.collect()) == brute_matches(pattern, facts, nodes, rels)


@pytest.mark.parametrize("pattern", [[("P", "r", "Q")], [("P", "r", "UNKNOWN1"), ("UNKNOWN1", "s", "Q")], [("P", "r", "Q"), ("Q", "s", "UNKNOWN"), ("UNKNOWN", "r", "P")], [("UNKNOWN1", "r", "P"), ("P", "s", "Q"), ("P", "t", "UNKNOWN2")], [("P", "r", "P")]])
@pytest.mark.parametrize("k", [1, 4])
def test_bounded_matching_keeps_the_best(spark, pattern, k):
    """Costs in few steps, so that many matches tie at the threshold."""
    rng = random.Random(k + len(pattern))
    names = [f"n{i}" for i in range(9)]
    facts = {(rng.choice(names), rng.choice("rst"), rng.choice(names)) for _ in range(40)} | {("n1", "r", "n1")}
    nodes = {"P": {n: rng.choice((0.0, 0.25, 0.75)) for n in names[:5]}, "Q": {n: rng.choice((0.0, 0.25, 0.75)) for n in names[2:]}}
    rels = {"r": {"r": 0.0, "s": 0.5}, "s": {"s": 0.0, "t": 0.5}, "t": {"t": 0.0}}
    got = P.match_pattern(pattern, *frames(spark, facts, nodes, rels), k=k)
    assert sorted((round(r["score"], 9), r["reuse"], r["edges"]) for r in got.collect()) == brute_matches(pattern, facts, nodes, rels)[:k]


def test_bounded_matching_makes_few_rows(spark):
    facts = {(f"a{i}", "r", f"h{i % 20}") for i in range(400)} | {(f"h{i}", "s", f"z{j}") for i in range(20) for j in range(30)}
    nodes = {"P": {f"a{i}": i / 400 for i in range(400)}, "Q": {f"z{j}": j / 31 for j in range(30)} | {f"y{i}": 0.0 for i in range(500)}}
    pattern = [("P", "r", "UNKNOWN"), ("UNKNOWN", "s", "Q")]
    f, n, r = frames(spark, facts, nodes, {"r": {"r": 0.0}, "s": {"s": 0.0}})
    adj, rows = P.adjacency(f, False), []
    best = P.match_component(pattern, adj, n, r, {"P": 400, "Q": 530}, 3, rows)
    assert sum(rows) < 60 and P.match_component(pattern, adj, n, r, {"P": 400, "Q": 530}).count() == 400 * 30
    assert sorted(round(x["score"], 9) for x in best.collect())[:3] == sorted(round(i / 400 + j / 31, 9) for i in range(400) for j in range(30))[:3]


def test_gate_makes_the_far_node_cheaper(spark):
    facts = {("R", "any", "x1"), ("R", "any", "x2"), ("x1", "k", "y1"), ("x2", "k", "y2")}
    nodes = {"R": {"R": 0.0}, "X": {"x1": 0.1, "x2": 0.3}, "Y": {"y1": 0.5, "y2": 0.7}}
    pattern = [("R", "UNKNOWN", "X"), ("X", "known", "Y")]
    assert P.best_score(pattern, *frames(spark, facts, nodes, {"known": {"k": 0.9}})) == pytest.approx(1.0)


def test_pattern_reasons(spark):
    f = frames(spark, {("a", "r", "b")}, {"P": {"zz": 0.0}}, {"r": {"r": 0.0}})
    assert P.match_with_reason([], *f)[1] == "empty_condition_triples"
    assert P.match_with_reason([("UNKNOWN", "r", "UNKNOWN2")], *f)[1] == "no_similar_root_node"
    assert P.match_with_reason([("P", "r", "UNKNOWN2")], *f)[1] == "no_similar_root_node"
    assert P.best_score([], *f) == 0.0
    assert P.best_score([("P", "r", "UNKNOWN2")], *f) == float("inf")


def test_logic_queries(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c"), ("b", "s", "c")], "head string, relation string, tail string")
    entities = spark.createDataFrame([(x,) for x in "abc"], "entity string")
    run = lambda q: {r["entity"] for r in G.run_logic(G.to_postfix(q), edges, entities).collect()}
    pa = ("p", ("e", "a"), "r")
    assert run(pa) == {"b", "c"}
    assert run(("i", pa, ("p", ("e", "b"), "s"))) == {"c"}
    assert run(("u", ("e", "a"), ("e", "b"))) == {"a", "b"}
    assert run(("n", pa)) == {"a"}
    assert G.readable(("i", pa, ("n", ("e", "b")))) == "(r(a) and not (b))"


def test_message_passing(spark):
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("c", "b", "r", 2.0)], "src string, dst string, rel string, w double")
    x = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 1.0), ("c", 0, 3.0)], "node string, dim int, x double")
    rel = spark.createDataFrame([("r", 0, 0.5)], "rel string, dim int, r double")
    assert rows(G.spmm(edges, x, rel), "node", "x") == [("b", 4.0)]
    assert rows(G.spmm(edges, x, rel, "max", "add"), "node", "x") == [("b", 7.0)]
    assert dict(rows(G.aggregate_messages(edges, x, rel, x, "mean"), "node", "x"))["b"] == pytest.approx((1 + 3 + 1) / 3)


def test_nearest_and_dimension_check(spark):
    index = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "name int, v array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.1])], "q int, v array<double>")
    assert [r["name"] for r in G.nearest(queries, index, 2).orderBy("rank").collect()] == [2, 3]
    assert G.nearest(queries.where("q < 0"), index, 2).count() == 0
    with pytest.raises(Exception, match="vector size"):
        G.check_dimensions(index, 3).collect()


def test_rouge_l_matches_plain_dynamic_programming(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(0, 90))], [rng.choice("abcd") for _ in range(rng.randrange(1, 80))]) for _ in range(30)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for r in df.select("i", M.rouge_l("a", "b").alias("f")).collect():
        a, b = pairs[r["i"]]
        n = lcs(a, b)
        assert r["f"] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps({"d1": "one", "d2": "two"}))
    assert rows(readers.corpus(spark, str(tmp_path / "corpus.json")), "doc_id", "text") == [("d1", "one"), ("d2", "two")]
    (tmp_path / "list.json").write_text(json.dumps([{"doc_id": "a", "title": "A"}, {"title": "B"}, {"text": "c"}]))
    assert rows(readers.multimodal(spark, str(tmp_path / "list.json")), "doc_id") == [("B",), ("a",), ("doc_2",)]
    (tmp_path / "dict.json").write_text(json.dumps({"k": {"text": "x"}}))
    assert rows(readers.multimodal(spark, str(tmp_path / "dict.json")), "doc_id", "title", "text") == [("k", "k", "x")]
    (tmp_path / "kg.txt").write_text("a,r,b\nbad line\nb,s,c\nx,y,z,w\n")
    t = readers.triple_file(spark, str(tmp_path / "kg.txt"))
    assert rows(t, "head", "relation", "tail") == [("a", "r", "b"), ("b", "s", "c")]
    ent, rel = encode.dictionaries(t)
    assert [r["name"] for r in ent.orderBy("id").collect()] == ["a", "b", "c"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=False), "a") == [(1,), (2,)]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    (tmp_path / "de.json").write_text(json.dumps({"d": ["x", "y"], "e": "no list"}))
    assert rows(readers.doc_entity_file(spark, str(tmp_path / "de.json")), "doc_id", "entity") == [("d", "x"), ("d", "y")]


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "out")
    sinks.write_if_absent(df, path)
    sinks.write_if_absent(df.where("id = 1"), path)
    assert spark.read.parquet(path).count() == 2
    done = []
    sinks.append_missing(df, str(tmp_path / "cache"), ["id"], lambda x: done.append(x.count()) or x)
    sinks.append_missing(df.unionByName(spark.createDataFrame([(3, "c")], "id int, v string")), str(tmp_path / "cache"), ["id"], lambda x: done.append(x.count()) or x)
    assert done == [2, 1]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3
    assert sinks.fingerprint({"b": 1, "a": 2}) == sinks.fingerprint({"a": 2, "b": 1})


def test_incremental_stream_appends_new_keys_once(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    df.write.parquet(source)
    for extra in ([], [(2, "b"), (3, "c")]):
        if extra:
            spark.createDataFrame(extra, "id long, v string").write.mode("append").parquet(source)
        incremental.append_new(spark.readStream.schema(df.schema).parquet(source), sink, ["id"], str(tmp_path / "ckpt"), lambda x: x)
    assert rows(spark.read.parquet(sink), "id") == [(1,), (2,), (3,)]


def test_components_contract(spark, monkeypatch):
    """Paths in and against order, stars around large and small names, loops and random graphs; leaves are written in the first round only."""
    import random

    from tierlink.operators import components as module

    rng = random.Random(5)
    path = list(range(1000, 1040))
    mixed = rng.sample(range(2000, 2040), 40)
    edges = list(zip(path, path[1:])) + list(zip(mixed, mixed[1:])) + [(3099, i) for i in range(3000, 3020)] + [(4000, i) for i in range(4001, 4020)] + [(7, 7), (7, 7), (8, 8), (8, 9)]
    edges += [(rng.randrange(5000, 5060), rng.randrange(5000, 5060)) for _ in range(45)]
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    sizes, plain = [], module.materialize

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    pairs = [(r["node"], r["component"]) for r in got.collect()]
    assert len(pairs) == len(want) and dict(pairs) == want
    monkeypatch.setattr(module, "materialize", counted)
    stars = [(f"c{i // 10}", f"o{i}") for i in range(300)] + [(f"c{i}", f"g{i // 3}") for i in range(30)]
    assert connected_components(spark.createDataFrame(stars, "src string, dst string")).count() == 340
    assert sum(sizes) < 1500  # 1,700 at least when every round writes every node


def test_documents_of_the_same_nodes_are_scored_once(spark):
    """Samples, an anchor with two nodes of a document, distances beyond the cut, and 200 documents of two sets of nodes, whose product with the anchors isn't shuffled."""
    rows_ = [(1, f"anchor {a}", n, 0.1 * a + (0.5 if n == "y" else 0.0)) for a in range(12) for n in "xy"] + [(2, "anchor 3", "x", 0.2), (2, "anchor 4", "z", 0.1)]
    near = spark.createDataFrame(rows_, "sample_id int, anchor string, node string, distance double")
    facts = spark.createDataFrame([(f"t{d}{n}", f"d{d}") for d in range(200) for n in ("xy" if d % 2 else "x")] + [("tz", "d0")], "triple_id string, doc_id string")
    incident = spark.createDataFrame([(n, f"t{d}{n}") for d in range(200) for n in ("xy" if d % 2 else "x")] + [("z", "tz"), ("x", "tz"), ("w", "tz")], "node string, triple_id string")
    want = {}
    nodes = {f"d{d}": ("xy" if d % 2 else "x") + ("z" if d == 0 else "") for d in range(200)}
    for doc, own in nodes.items():
        best = {}
        for sample, anchor, n, far in rows_:
            if n in own and far <= 1.0:
                best[sample, anchor] = max(best.get((sample, anchor), 0.0), 0.9 / (1 + far))
        for (sample, _), s in best.items():
            want[sample, doc] = want.get((sample, doc), 0.0) + s
    got = R.anchor_doc_scores(near, incident, facts)
    assert {(r["sample_id"], r["doc_id"]): round(r["score"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "m1" in plan and "Aggregate [sample_id" in plan and not any("Aggregate [" in line and "doc_id" in line.split("]")[0] and "anchor" in line.split("]")[0] for line in plan.splitlines())


def test_ranking_tasks_are_bounded(spark, monkeypatch):
    """The pairs of scores and documents are dealt to tasks by their number; common words don't meet in one."""
    monkeypatch.setattr(R, "PAIRS", 64)
    docs = spark.createDataFrame([(d, f"w{w}") for d in range(60) for w in range(4) if w == 0 or d % w == 0], "doc_id int, entity string")
    seeds = spark.createDataFrame([(s, f"w{w}", 1.0 + w) for s in range(10) for w in range(3)], "sample_id int, entity string, w double")
    parts = R.in_parts(seeds, docs)
    n = 10 * (60 + 60 + 30)
    assert parts.count() == n and parts.rdd.getNumPartitions() >= n / 64
    got = {(r["sample_id"], r["doc_id"]): r["score"] for r in R.simple_rank(seeds, docs).collect()}
    assert got == {(s, d): 3.0 + 3.0 * (d % 2 == 0) for s in range(10) for d in range(60)}
    empty = R.simple_rank(seeds.where("false"), docs)
    assert empty.count() == 0
