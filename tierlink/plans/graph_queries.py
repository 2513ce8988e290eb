"""Catalogue of graph computation, vectors, set algebra, pattern matching, path relations and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.functions.numeric import norm  # noqa: F401
from tierlink.operators import graph as G
from tierlink.operators import pattern as P
from tierlink.operators import prompts as A
from tierlink.operators import rank as R
from tierlink.plans import views as V
from tierlink.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# -- set algebra -----------------------------------------------------------------------------------
@query("u01_except", "SELECT page_id AS id FROM pages EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def _(s, d):
    return table(s, d, "pages").select(F.col("page_id").alias("id")).exceptAll(table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))).distinct()


@query("u02_union_distinct", f"WITH {V.TRIPLES} SELECT head AS entity FROM v_triples UNION SELECT tail FROM v_triples")
def _(s, d):
    t = V.triples(s, d)
    return t.select(F.col("head").alias("entity")).union(t.select("tail")).distinct()


@query("u03_intersect", f"WITH {V.GOLD} SELECT sample_id, count(*) AS n FROM v_gold JOIN (SELECT doc_id FROM labels) USING (doc_id) GROUP BY 1")
def _(s, d):
    both = V.gold(s, d).select("sample_id", "doc_id").intersect(V.gold(s, d).join(table(s, d, "labels").select("doc_id"), "doc_id").select("sample_id", "doc_id"))
    return both.groupBy("sample_id").agg(F.count("*").alias("n"))


E_SQL = f"WITH {V.TRIPLES}, e AS (SELECT DISTINCT head, relation, tail FROM v_triples)"


def _triples(s, d):
    return V.triples(s, d).select("head", "relation", "tail").distinct()


LOGIC = ("i", ("p", ("p", ("e", "asia"), "inv in region"), "inv in nation"), ("n", ("p", ("e", "building"), "inv in segment")))


@query("u07_logic_query", E_SQL + ", n AS (SELECT head FROM e WHERE relation = 'in region' AND tail = 'asia') SELECT DISTINCT head AS entity FROM e WHERE relation = 'in nation' AND tail IN (SELECT head FROM n) AND head NOT IN (SELECT head FROM e WHERE relation = 'in segment' AND tail = 'building')")
def _(s, d):
    t = _triples(s, d)
    both = t.unionByName(t.select(F.col("tail").alias("head"), F.concat(F.lit("inv "), "relation").alias("relation"), F.col("head").alias("tail")))
    entities = t.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()
    return G.run_logic(G.to_postfix(LOGIC), both, entities)


# -- link prediction ----------------------------------------------------------------------------------
EDGE = "e AS (SELECT DISTINCT head, relation, tail FROM v_triples)"


BATCH = "b AS (SELECT n_nationkey AS qid, lower(n_name) AS head, 'in region' AS relation, lower(r_name) AS tail FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _batch(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("qid"), F.lower("n_name").alias("head"), F.lit("in region").alias("relation"), F.lower("r_name").alias("tail"))


@query("j01_edge_match", f"WITH {V.TRIPLES}, {BATCH} SELECT qid, seq AS edge_id FROM v_triples t JOIN b ON t.tail = b.head")
def _(s, d):
    e = V.triples(s, d).select(F.col("tail").alias("k"), F.col("seq").alias("edge_id"))
    return G.edge_match(e, _batch(s, d).select("qid", F.col("head").alias("k")), ["k"])


@query("j01_match_counts", f"WITH {V.TRIPLES}, {BATCH}, c AS (SELECT tail, count(*) AS n FROM v_triples GROUP BY 1) SELECT qid, coalesce(n, 0) AS n_match FROM b LEFT JOIN c ON c.tail = b.head")
def _(s, d):
    return G.match_counts(V.triples(s, d).select(F.col("tail").alias("k")), _batch(s, d).select("qid", F.col("head").alias("k")), ["k"])


@query("j02_strict_negatives", f"WITH {V.TRIPLES}, {EDGE}, {BATCH}, nodes AS (SELECT head AS node FROM e UNION SELECT tail FROM e) SELECT qid, node AS candidate FROM b, nodes WHERE (head, relation, node) NOT IN (SELECT (head, relation, tail) FROM e)")
def _(s, d):
    e = _triples(s, d)
    nodes = e.select(F.explode(F.array("head", "tail")).alias("node")).distinct()
    return G.strict_negatives(_batch(s, d), e, nodes).select("qid", "candidate")


@query("j03_all_negatives", f"WITH {V.TRIPLES}, {EDGE}, {BATCH} SELECT qid, node AS candidate FROM b, (SELECT head AS node FROM e UNION SELECT tail FROM e)")
def _(s, d):
    nodes = _triples(s, d).select(F.explode(F.array("head", "tail")).alias("node")).distinct()
    return G.all_negatives(_batch(s, d), nodes).select("qid", "candidate")


@query("f08_remove_easy_edges", f"WITH {V.TRIPLES}, {EDGE} SELECT '3' AS kind, head, relation, tail FROM e WHERE NOT (relation = 'in region' AND tail = 'asia') UNION ALL SELECT '2', head, relation, tail FROM e WHERE (head, tail) NOT IN (SELECT (head, tail) FROM e WHERE tail = 'asia')")
def _(s, d):
    e = _triples(s, d)
    batch = e.where("tail = 'asia'")
    return G.remove_easy_edges(e, batch).select(F.lit("3").alias("kind"), "head", "relation", "tail").unionByName(G.remove_easy_edges(e, batch, True).select(F.lit("2").alias("kind"), "head", "relation", "tail"))


@query("f09_beam_edge_mask", f"WITH {V.TRIPLES}, {EDGE} SELECT head, tail FROM e WHERE head <> 'nation_1'")
def _(s, d):
    return _triples(s, d).where(F.col("head") != "nation_1").select("head", "tail")


@query("f10_limit_nodes", f"WITH {V.SCORE} SELECT sample, id, score FROM v_score WHERE id IN (SELECT doc_id FROM labels)")
def _(s, d):
    return V.scores(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("sample", "id", "score")


@query("g18_negatives", f"""WITH {V.TRIPLES}, {EDGE}, {BATCH}, nodes AS (SELECT head AS node FROM e UNION SELECT tail FROM e), neg AS (SELECT qid, node AS candidate, row_number() OVER (PARTITION BY qid ORDER BY node) - 1 AS k, count(*) OVER (PARTITION BY qid) AS m FROM b, nodes WHERE (head, relation, node) NOT IN (SELECT (head, relation, tail) FROM e)),
dr AS (SELECT DISTINCT qid, m, draw, floor(('0x' || left(md5(qid || '|' || draw || '|42'), 8))::BIGINT / 4294967296.0::DOUBLE * m)::BIGINT AS k FROM neg, (SELECT unnest(generate_series(0, 4)) AS draw)) SELECT qid, draw, candidate FROM dr JOIN neg USING (qid, k)""")
def _(s, d):
    e = _triples(s, d)
    nodes = e.select(F.explode(F.array("head", "tail")).alias("node")).distinct()
    return G.sample_negatives(_batch(s, d), e, nodes, 5).select("qid", F.col("draw").cast("long").alias("draw"), "candidate")


@query("g19_tail_form", f"WITH {BATCH} SELECT qid, CASE WHEN qid % 2 = 0 THEN tail ELSE head END AS head, CASE WHEN qid % 2 = 0 THEN 7 ELSE 1 END AS relation, CASE WHEN qid % 2 = 0 THEN head ELSE tail END AS tail FROM b")
def _(s, d):
    return G.to_tail_form(_batch(s, d).withColumn("relation", F.lit(1)).withColumn("corrupt_head", F.col("qid") % 2 == 0), 6)


@query("j20_relation_graph", E_SQL + """, h AS (SELECT DISTINCT head AS n, relation AS r FROM e), t AS (SELECT DISTINCT tail AS n, relation AS r FROM e)
SELECT DISTINCT x.r AS a, y.r AS b, 'hh' AS kind FROM h x JOIN h y USING (n) UNION SELECT DISTINCT x.r, y.r, 'tt' FROM t x JOIN t y USING (n) UNION SELECT DISTINCT x.r, y.r, 'ht' FROM h x JOIN t y USING (n) UNION SELECT DISTINCT x.r, y.r, 'th' FROM t x JOIN h y USING (n)""")
def _(s, d):
    return G.relation_graph(_triples(s, d))


# -- message passing ------------------------------------------------------------------------------------
STATE = E_SQL + """, x AS (SELECT node, dim, sqrt(((ascii(node) * 31 + length(node) * 7 + dim) % 10 + 1)::DOUBLE) / 3 AS x FROM (SELECT head AS node FROM e UNION SELECT tail FROM e), (SELECT unnest([0, 1]) AS dim)),
rl AS (SELECT relation AS rel, dim, ((length(relation) * 3 + dim) % 5)::DOUBLE / 5 + 0.1 AS r FROM (SELECT DISTINCT relation FROM e), (SELECT unnest([0, 1]) AS dim)),
m AS (SELECT e.tail AS node, x.dim, r AS r, x AS x FROM e JOIN x ON e.head = x.node JOIN rl ON rl.rel = e.relation AND rl.dim = x.dim)"""


def _state(s, d):
    e = _triples(s, d)
    dims = F.explode(F.array(F.lit(0), F.lit(1))).alias("dim")
    x = e.select(F.explode(F.array("head", "tail")).alias("node")).distinct().select("node", dims)
    # square roots, so that no rounded mean is a tie
    x = x.withColumn("x", F.sqrt(((F.ascii("node") * 31 + F.length("node") * 7 + F.col("dim")) % 10 + 1).cast("double")) / 3)
    rel = e.select(F.col("relation").alias("rel")).distinct().select("rel", dims)
    rel = rel.withColumn("r", ((F.length("rel") * 3 + F.col("dim")) % 5).cast("double") / 5 + 0.1)
    edges = e.select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.col("relation").alias("rel"), F.lit(1.0).alias("w"))
    return edges, x, rel


for _add in ("sum", "min", "max"):
    for _mul in ("mul", "add"):
        _op = "r * x" if _mul == "mul" else "r + x"
        query(f"g05_spmm_{_add}_{_mul}", STATE + f" SELECT node, dim, round({_add}({_op}), 6) AS x FROM m GROUP BY ALL")(
            lambda s, d, a=_add, m=_mul: G.spmm(*_state(s, d), a, m).withColumn("x", F.round("x", 6))
        )


def _boundary(x):
    return x.withColumn("x", F.col("x") + 0.5)


WITH_B = STATE + ", mb AS (SELECT node, dim, r * x AS m FROM m UNION ALL SELECT node, dim, x + 0.5 FROM x)"
for _kind, _f in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min")):
    query(f"g07_aggregate_{_kind}", WITH_B + f" SELECT node, dim, round({_f}(m), 6) AS x FROM mb GROUP BY ALL")(
        lambda s, d, k=_kind: (lambda e, x, r: G.aggregate_messages(e, x, r, _boundary(x), k))(*_state(s, d)).withColumn("x", F.round("x", 6))
    )


@query("g07_pna", WITH_B + """, a AS (SELECT node, dim, avg(m) AS x_mean, max(m) AS x_max, min(m) AS x_min, sqrt(greatest(avg(m * m) - avg(m) * avg(m), 1e-6)) AS x_std FROM mb GROUP BY ALL),
dg AS (SELECT node, ln(count(*)) AS ld FROM (SELECT tail AS node FROM e UNION ALL SELECT DISTINCT node FROM x) GROUP BY 1), sc AS (SELECT node, ld / (SELECT avg(ld) FROM dg) AS s FROM dg)
SELECT node, dim, round(x_mean, 8) AS x_mean, round(x_max * s, 8) AS x_max_amp, round(x_std / greatest(s, 0.01), 7) AS x_std_inv FROM a JOIN sc USING (node)""")
def _(s, d):
    e, x, r = _state(s, d)
    a = G.aggregate_messages(e, x, r, _boundary(x), "pna")
    return a.select("node", "dim", F.round("x_mean", 8).alias("x_mean"), F.round("x_max_amp", 8).alias("x_max_amp"), F.round("x_std_inv", 7).alias("x_std_inv"))


def _layer(i, prev):
    return f", y{i} AS (SELECT node, dim, greatest(sum(m), 0) AS x FROM (SELECT e.tail AS node, p.dim, r * p.x AS m FROM e JOIN {prev} p ON e.head = p.node JOIN rl ON rl.rel = e.relation AND rl.dim = p.dim UNION ALL SELECT node, dim, x FROM b0) GROUP BY ALL), x{i} AS (SELECT node, dim, sum(x) AS x FROM (SELECT * FROM y{i} UNION ALL SELECT * FROM {prev}) GROUP BY ALL)"


@query("g08_propagate_2hop", STATE + ", b0 AS (SELECT node, dim, x + 0.5 AS x FROM x)" + _layer(1, "b0") + _layer(2, "x1") + " SELECT node, dim, round(x, 4) AS x FROM x2")
def _(s, d):
    e, x, r = _state(s, d)
    return G.propagate(e, _boundary(x), r, 2).select("node", "dim", F.round("x", 4).alias("x"))


@query("g20_seed_features", f"WITH {V.SEEDS} SELECT sample_id AS sample, entity AS node, dim, w * (dim + 0.5) AS x FROM v_seed, (SELECT unnest([0, 1]) AS dim)")
def _(s, d):
    seeds = V.seeds(s, d).select(F.col("sample_id").alias("sample"), F.col("entity").alias("node"), "w")
    q = seeds.select("sample").distinct().select("sample", F.explode(F.array(F.lit(0), F.lit(1))).alias("dim")).withColumn("q", F.col("dim") + 0.5)
    return G.seed_features(seeds, q)


# -- equivalence, flows, walks ------------------------------------------------------------------------
EQ = "q AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION ALL SELECT 'c' || o_custkey, 'g' || (o_custkey // 3) FROM orders)"


@query("g10_components", f"WITH RECURSIVE {EQ}, und AS (SELECT a, b FROM q UNION SELECT b, a FROM q), r AS (SELECT a AS name, a AS reach FROM und UNION SELECT r.name, und.b FROM r JOIN und ON r.reach = und.a) SELECT name, min(reach) AS canonical FROM r GROUP BY name")
def _(s, d):
    o = table(s, d, "orders")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    customer = name("c", F.col("o_custkey")).alias("head")
    e = o.select(customer, name("o", F.col("o_orderkey")).alias("tail")).unionByName(o.select(customer, name("g", F.floor(F.col("o_custkey") / 3)).alias("tail")))
    return G.canonical_names(e)


@query("g11_lookup_keys", "SELECT p_partkey, k FROM (SELECT p_partkey, unnest(list_distinct([p_name, trim(regexp_replace(lower(trim(p_name)), '[^0-9a-z]+', ' ', 'g')), p_brand])) AS k FROM part)")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.explode(T.lookup_keys("p_name", "p_brand")).alias("k"))


FLOW = E_SQL + """, ed AS (SELECT 0 AS layer, head AS src, tail AS dst, relation AS rel, ((length(head) * 7 + ascii(tail)) % 11)::DOUBLE / 5 AS logit FROM e UNION ALL SELECT 1, tail, head, 'inv ' || relation, ((length(head) * 3 + ascii(tail)) % 13)::DOUBLE / 5 FROM e WHERE relation IN ('in region', 'in nation')),
fl AS (SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS flow FROM ed WINDOW w AS (PARTITION BY layer, dst)), lf AS (SELECT *, ln(greatest(flow, 1e-12)) AS log_flow FROM fl),
pr AS (SELECT lower(n_name) AS node, ln(((n_nationkey + 1)::DOUBLE) / (SELECT sum(n_nationkey + 1) FROM nation)) AS log_mass FROM nation)"""


def _flows(s, d):
    e = _triples(s, d)
    a = e.select(F.lit(0).alias("layer"), F.col("head").alias("src"), F.col("tail").alias("dst"), F.col("relation").alias("rel"), (((F.length("head") * 7 + F.ascii("tail")) % 11).cast("double") / 5).alias("logit"))
    b = e.where("relation in ('in region', 'in nation')").select(F.lit(1).alias("layer"), F.col("tail").alias("src"), F.col("head").alias("dst"), F.concat(F.lit("inv "), "relation").alias("rel"), (((F.length("head") * 3 + F.ascii("tail")) % 13).cast("double") / 5).alias("logit"))
    flows = G.local_flow(a.unionByName(b))
    prior = G.source_prior(table(s, d, "nation").select(F.lower("n_name").alias("node"), (F.col("n_nationkey") + 1).cast("double").alias("w")))
    return flows, prior


@query("g12_local_flow", FLOW + " SELECT layer, src, rel, dst, round(flow, 9) AS flow, round(log_flow, 6) AS log_flow FROM lf")
def _(s, d):
    return _flows(s, d)[0].select("layer", "src", "rel", "dst", F.round("flow", 9).alias("flow"), F.round("log_flow", 6).alias("log_flow"))


@query("g13_source_prior", FLOW + " SELECT node, round(log_mass, 9) AS log_mass FROM pr")
def _(s, d):
    return _flows(s, d)[1].select("node", F.round("log_mass", 9).alias("log_mass"))


MASS = FLOW + ", m1 AS (SELECT dst AS node, ln(sum(exp(log_mass + log_flow))) AS log_mass FROM lf JOIN pr ON src = node WHERE layer = 0 GROUP BY dst), m2 AS (SELECT dst AS node, ln(sum(exp(log_mass + log_flow))) AS log_mass FROM lf JOIN m1 ON src = node WHERE layer = 1 GROUP BY dst)"


@query("g14_path_mass", MASS + " SELECT node, round(log_mass, 6) AS log_mass FROM m2")
def _(s, d):
    return G.path_mass(*_flows(s, d), 2).select("node", F.round("log_mass", 6).alias("log_mass"))


VITERBI = FLOW + """, v1 AS (SELECT dst AS node, log_mass + log_flow AS score, src || '>' || rel || '>' || dst || ';' AS text FROM lf JOIN pr ON src = node WHERE layer = 0 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY log_mass + log_flow DESC, text) <= 2),
v2 AS (SELECT dst AS node, score + log_flow AS score, text || src || '>' || rel || '>' || dst || ';' AS text FROM lf JOIN v1 ON src = node WHERE layer = 1), v3 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, text) AS rank FROM v2 QUALIFY rank <= 2)"""


@query("g15_viterbi_k2", VITERBI + " SELECT node, rank, round(score, 6) AS score, text FROM v3")
def _(s, d):
    return G.viterbi(*_flows(s, d), 2, 2).select("node", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "text")


@query("g16_explain_paths", MASS + VITERBI[len(FLOW):] + """, sc AS (SELECT DISTINCT node, length(node)::DOUBLE AS score FROM m2), a AS (SELECT node, 0 AS s, row_number() OVER (ORDER BY score DESC, node) AS r FROM sc), b AS (SELECT node, 1 AS s, row_number() OVER (ORDER BY log_mass DESC, node) AS r FROM m2),
u AS (SELECT node, min(s * 1000 + r) AS k FROM (SELECT * FROM a WHERE r <= 5 UNION ALL SELECT * FROM b WHERE r <= 5) GROUP BY 1), t AS (SELECT node, row_number() OVER (ORDER BY k) AS position FROM u) SELECT node, position, score AS target_score, rank, text FROM t LEFT JOIN sc USING (node) LEFT JOIN (SELECT node, rank, text FROM v3) USING (node)""")
def _(s, d):
    flows, prior = _flows(s, d)
    mass = G.path_mass(flows, prior, 2).withColumn("log_mass", F.round("log_mass", 12))
    scores = mass.select("node", F.length("node").cast("double").alias("score"))
    x = G.explain_paths(scores, mass, G.viterbi(flows, prior, 2, 2), 5, 5)
    return x.select("node", F.col("position").cast("long").alias("position"), "target_score", F.col("rank").cast("long").alias("rank"), "text")


@query("g17_average_length", VITERBI + " SELECT node, round(score / 2, 6) AS mean_score, text FROM v3 ORDER BY score / 2 DESC, text LIMIT 10")
def _(s, d):
    return G.average_length_paths(G.viterbi(*_flows(s, d), 2, 2), 2, 10).select("node", F.round("mean_score", 6).alias("mean_score"), "text")


# -- path relations -----------------------------------------------------------------------------------
HOPS = """hops AS (SELECT l_returnflag AS sample, l_orderkey AS path, l_linenumber AS pos, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n_hops, 'p' || (l_partkey % 60) AS head, 'p' || (l_suppkey % 60) AS tail, CASE WHEN l_linenumber % 5 = 0 THEN -1.0 ELSE l_discount * 10 END::DOUBLE AS score FROM lineitem),
dk AS (SELECT DISTINCT f AS sample, 'p' || i AS key, 'd' || (i % 20) AS doc FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT unnest(generate_series(0, 59)) AS i)),
hw AS (SELECT *, CASE WHEN score > 0 THEN score ELSE 1.0 END / n_hops AS weight FROM hops), sp AS (SELECT sample, head, tail, weight FROM hw UNION ALL SELECT a.sample, a.head, b.tail, a.weight * 0.4 FROM hw a JOIN hw b ON a.sample = b.sample AND a.path = b.path AND b.pos = a.pos + 1),
rel AS (SELECT sp.sample, least(x.doc, y.doc) AS a, greatest(x.doc, y.doc) AS b, sum(weight) AS score, count(*) AS n_evidence FROM sp JOIN dk x ON sp.sample = x.sample AND sp.head = x.key JOIN dk y ON sp.sample = y.sample AND sp.tail = y.key WHERE x.doc <> y.doc GROUP BY ALL)"""


def _relations(s, d):
    li = table(s, d, "lineitem")
    n = F.count("*").over(Window.partitionBy("l_orderkey", "l_returnflag"))
    score = F.when(F.col("l_linenumber") % 5 == 0, -1.0).otherwise(F.col("l_discount") * 10)
    hops = li.select(F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pos"), n.alias("n_hops"), F.concat(F.lit("p"), (F.col("l_partkey") % 60).cast("string")).alias("head"), F.concat(F.lit("p"), (F.col("l_suppkey") % 60).cast("string")).alias("tail"), score.alias("score"))
    flags = li.select(F.col("l_returnflag").alias("sample")).distinct()
    keys = flags.select("sample", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i")).select("sample", F.concat(F.lit("p"), F.col("i").cast("string")).alias("key"), F.concat(F.lit("d"), (F.col("i") % 20).cast("string")).alias("doc"))
    return R.path_relations(hops, keys)


@query("g09_path_relations", f"WITH {HOPS} SELECT sample, a, b, round(score, 5) AS score, n_evidence FROM rel")
def _(s, d):
    return _relations(s, d).withColumn("score", F.round("score", 5))


@query("w17_pair_links", f"WITH {HOPS}, n AS (SELECT sample, a AS doc, b AS id, round(score, 5) AS score FROM rel UNION ALL SELECT sample, b, a, round(score, 5) FROM rel) SELECT *, row_number() OVER (PARTITION BY sample, doc ORDER BY score DESC, id) AS rank FROM n QUALIFY rank <= 5")
def _(s, d):
    return R.neighbours(_relations(s, d).withColumn("score", F.round("score", 5))).withColumn("rank", F.col("rank").cast("long"))


# -- pattern matching -----------------------------------------------------------------------------------
PAT = E_SQL + """, kn AS (SELECT head AS n FROM e UNION SELECT tail FROM e), nc AS (SELECT q, n AS name, (abs(length(n) - length(q)) % 4)::DOUBLE / 5 AS distance FROM kn, (SELECT unnest(['asia', 'nation_1', 'building']) AS q) WHERE left(n, 1) = left(q, 1)),
rc AS (SELECT q, relation AS name, CASE WHEN relation = q THEN 0.0 ELSE 0.7 END::DOUBLE AS distance FROM (SELECT DISTINCT relation FROM e), (SELECT unnest(['in region', 'in nation']) AS q))"""


def _candidates(s, d):
    """Names with the initial of a pattern's name stand in for those that vector search would find."""
    e = _triples(s, d)
    kn = e.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    q = s.range(1).select(F.explode(F.array(F.lit("asia"), F.lit("nation_1"), F.lit("building"))).alias("q"))
    nc = kn.join(q, F.substring("name", 1, 1) == F.substring("q", 1, 1)).select("q", "name", ((F.abs(F.length("name") - F.length("q")) % 4).cast("double") / 5).alias("distance"))
    rq = s.range(1).select(F.explode(F.array(F.lit("in region"), F.lit("in nation"))).alias("q"))
    rc = e.select(F.col("relation").alias("name")).distinct().join(F.broadcast(rq)).select("q", "name", F.when(F.col("name") == F.col("q"), 0.0).otherwise(0.7).alias("distance"))
    return e, nc, rc


def _match(pattern):
    def run(s, d):
        m = P.match_pattern(pattern, *_candidates(s, d), k=20)
        return m.select(F.round("score", 6).alias("score"), "edges")

    return run


# the region has fewest candidates, so it is the root; no edge leaves a region, so backward edges match
query("g01_pattern_1edge", PAT + ", m AS (SELECT round(a.distance + b.distance + CASE WHEN b.distance <= 0.6 THEN rc.distance ELSE 0 END + 0.25, 6) AS score, b.name = a.name AS reuse, a.name || '>' || e.relation || '>' || b.name AS edges FROM e JOIN nc b ON b.q = 'nation_1' AND b.name = e.head JOIN nc a ON a.q = 'asia' AND a.name = e.tail JOIN rc ON rc.q = 'in region' AND rc.name = e.relation) SELECT score, edges FROM m ORDER BY score, reuse, edges LIMIT 20")(_match([("nation_1", "in region", "asia")]))
query("g01_pattern_wildcard", PAT + ", m AS (SELECT round(b.distance + rc.distance, 6) AS score, e.head = e.tail AS reuse, e.head || '>' || e.relation || '>' || e.tail AS edges FROM e JOIN nc b ON b.q = 'nation_1' AND b.name = e.head JOIN rc ON rc.q = 'in region' AND rc.name = e.relation) SELECT score, edges FROM m ORDER BY score, reuse, edges LIMIT 20")(_match([("nation_1", "in region", "UNKNOWN region")]))
ORACLE_SQL["g01_pattern_reverse"] = (PAT + ", bw AS (SELECT src, rel, dst, min(p) AS p FROM (SELECT head AS src, relation AS rel, tail AS dst, 0.0::DOUBLE AS p FROM e UNION ALL SELECT tail, relation, head, 0.25 FROM e) GROUP BY ALL), m AS (SELECT round(b.distance + rc.distance + p, 6) AS score, src = dst AS reuse, src || '>' || rel || '>' || dst AS edges FROM bw JOIN nc b ON b.q = 'asia' AND b.name = src AND b.name = 'asia' JOIN rc ON rc.q = 'in region' AND rc.name = rel) SELECT score, edges FROM m ORDER BY score, reuse, edges LIMIT 20")


def _two_edge(s, d):
    e, nc, rc = _candidates(s, d)
    c = e.where("relation = 'in nation'").select(F.explode(F.array("head")).alias("name")).distinct()
    many = c.select(F.lit("customer#1").alias("q"), "name", (F.length("name") % 3).cast("double").alias("distance"))
    m = P.match_pattern([("customer#1", "in nation", "UNKNOWN nation"), ("UNKNOWN nation", "in region", "asia")], e, nc.where("q = 'asia' and name = 'asia'").unionByName(many), rc, k=20)
    return m.select(F.round("score", 6).alias("score"), "edges")


BACKWARD = "bw AS (SELECT src, rel, dst, min(p) AS p FROM (SELECT head AS src, relation AS rel, tail AS dst, 0.0::DOUBLE AS p FROM e UNION ALL SELECT tail, relation, head, 0.25 FROM e) GROUP BY ALL)"
query("g01_pattern_2edge", PAT + f", {BACKWARD}, cu AS (SELECT DISTINCT head AS name, (length(head) % 3)::DOUBLE AS nd FROM e WHERE relation = 'in nation'), m AS (SELECT round(x.p + r1.distance + nd + CASE WHEN nd <= 0.6 THEN r2.distance ELSE 0 END + y.p, 6) AS score, y.dst = x.src OR y.dst = x.dst OR x.dst = x.src AS reuse, x.src || '>' || x.rel || '>' || x.dst || ';' || y.src || '>' || y.rel || '>' || y.dst AS edges FROM bw x JOIN rc r1 ON r1.q = 'in region' AND r1.name = x.rel JOIN bw y ON y.src = x.dst JOIN cu ON cu.name = y.dst JOIN rc r2 ON r2.q = 'in nation' AND r2.name = y.rel WHERE x.src = 'asia') SELECT score, edges FROM m ORDER BY score, reuse, edges LIMIT 20")(_two_edge)


def _reverse(s, d):
    e, nc, rc = _candidates(s, d)
    m = P.match_pattern([("asia", "in region", "UNKNOWN nation")], e, nc.where("q = 'asia' and name = 'asia'"), rc, k=20)
    return m.select(F.round("score", 6).alias("score"), "edges")


QUERIES["g01_pattern_reverse"] = _reverse


# -- vectors -----------------------------------------------------------------------------------------------
PAIRS = "q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT vec_id AS name, embedding::DOUBLE[] AS b FROM embeddings)"


def _vectors(s, d):
    e = table(s, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("name"), F.col("embedding").alias("v"))


L2 = "list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
COS = "list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a, lambda z: z * z))) * sqrt(list_sum(list_transform(b, lambda z: z * z))))"


@query("v01_l2_topk", f"WITH {PAIRS}, s AS (SELECT q, name, {L2} AS score FROM q, x) SELECT q, name, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9), name) AS rank FROM s QUALIFY rank <= 5")
def _(s, d):
    return G.nearest(*_vectors(s, d), 5).select("q", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


LINK = f"WITH {PAIRS}, s AS (SELECT q, name, {COS} AS score FROM q, x), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, name) AS rank FROM s QUALIFY rank <= 5), n AS (SELECT *, score / max(score) OVER (PARTITION BY q) AS norm_score FROM r)"


@query("v04_cosine_link", LINK + " SELECT q, name, rank, round(norm_score, 6) AS norm_score FROM n")
def _(s, d):
    return G.link_scores(G.nearest(*_vectors(s, d), 5, "cosine")).select("q", "name", F.col("rank").cast("long").alias("rank"), F.round("norm_score", 6).alias("norm_score"))


@query("j07_question_linking", LINK + " SELECT q, name FROM n WHERE rank = 1")
def _(s, d):
    return G.nearest(*_vectors(s, d), 1, "cosine").select("q", "name")


@query("j09_synonymy_edges", LINK + " SELECT q AS head, 'equivalent' AS relation, name AS tail FROM n WHERE norm_score >= 0.2 AND q <> name")
def _(s, d):
    return G.synonymy_edges(G.nearest(*_vectors(s, d), 5, "cosine"), 0.2)


@query("j09_augment", f"WITH {V.EDGES}, sy AS (SELECT DISTINCT head, tail FROM v_edges WHERE relation = 'in segment') SELECT head, CASE WHEN relation = 'in segment' THEN 'equivalent' ELSE relation END AS relation, tail FROM v_edges")
def _(s, d):
    e = V.edges(s, d)
    return G.augment(e, e.where("relation = 'in segment'").select("head", F.lit("equivalent").alias("relation"), "tail"))


@query("v03_check_dimensions", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def _(s, d):
    e = G.check_dimensions(table(s, d, "embeddings").select("label", F.col("embedding").alias("v")), 64)
    return e.where(F.size("v") == 64).groupBy("label").agg(F.count("*").alias("n"))


# -- prompts and arbitration ---------------------------------------------------------------------------------
@query("t01_chat_prompt", "SELECT conv_id, 'system: be brief' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def _(s, d):
    return A.chat_prompt(table(s, d, "conversations"), "be brief")


@query("t02_path_prompt", "SELECT p_partkey, concat_ws(chr(10), 'doc1: ' || p_brand, 'doc2: ' || p_type, 'doc3: ', 'doc4: ', 'doc5: ', 'links: doc1 - doc2', 'question: ' || p_name) AS prompt FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", A.path_prompt(F.col("p_name"), F.array("p_brand", "p_type"), F.lit("doc1 - doc2")).alias("prompt"))


@query("t03_standard_prompt", "SELECT p_partkey, concat_ws(chr(10), 'Q1', 'Q2', p_brand, p_type, 'Question: ' || p_name) AS prompt FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", A.standard_prompt(F.array(F.lit("Q1"), F.lit("Q2")), F.array("p_brand", "p_type"), F.col("p_name")).alias("prompt"))


@query("t04_path_links", f"WITH {HOPS}, top AS (SELECT f AS sample, 'd' || (i - 1) AS doc, i AS rank FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT unnest(generate_series(1, 5)) AS i)) SELECT sample, 'doc' || x.rank || ' - doc' || y.rank AS text FROM (SELECT sample, a, b, round(score, 5) AS score FROM rel) r JOIN top x USING (sample) JOIN top y USING (sample) WHERE x.doc = a AND y.doc = b QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, a, b) = 1")
def _(s, d):
    rel = _relations(s, d).withColumn("score", F.round("score", 5))
    top = rel.select("sample").distinct().select("sample", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("doc", F.concat(F.lit("d"), (F.col("rank") - 1).cast("string")))
    return A.path_links(rel, top)


@query("t06_answer_prompt", "SELECT p_partkey, concat_ws(chr(10), 'Context: ctx', 'Question: ' || p_name, '(A) ' || p_brand, '(B) ' || p_type, 'Answer with one letter.') AS prompt FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", A.answer_prompt(F.col("p_name"), F.array("p_brand", "p_type"), F.lit("ctx")).alias("prompt"))


@query("t07_describe", "SELECT page_id, concat_ws('. ', nullif(trim(url), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '')) AS description FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", A.describe_prompt(F.col("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("description"))


@query("t08_fewshot", "SELECT label, string_agg('Q: ' || question, chr(10) ORDER BY id) AS text FROM (SELECT event_type AS label, event_id AS id, props AS question FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 8) GROUP BY 1")
def _(s, d):
    return A.few_shot_prompt(table(s, d, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("id"), F.col("props").alias("question")))


@query("r07_choose_variant", "SELECT doc_id, CASE WHEN quality = 0 THEN 'plain' ELSE 'path' END AS answer FROM labels")
def _(s, d):
    x = table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "B").when(F.col("toxic") == 1, "").otherwise("A").alias("choice"), F.lit("path").alias("path"), F.lit("plain").alias("plain"))
    return A.choose_variant(x).select("doc_id", "answer")


@query("r08_arbitration", """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS direct, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS rag, CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS judge FROM labels),
s AS (SELECT *, CASE WHEN direct = '' AND rag = '' THEN 'none' WHEN direct = rag THEN 'auto_agree' WHEN judge = 'A' THEN 'judge_direct' WHEN judge = 'B' THEN 'judge_rag' ELSE 'fallback' END AS source FROM x) SELECT doc_id, source, CASE source WHEN 'none' THEN '' WHEN 'judge_direct' THEN direct WHEN 'fallback' THEN coalesce(nullif(rag, ''), direct) ELSE rag END AS final FROM s""")
def _(s, d):
    pick = lambda m: F.when(F.col("doc_id") % m == 0, "A").when(F.col("doc_id") % m == 1, "B").otherwise("")
    return A.arbitrate(table(s, d, "labels").select("doc_id", pick(3).alias("direct"), pick(4).alias("rag"), pick(5).alias("judge"))).select("doc_id", "source", "final")


@query("r10_budget_label", "SELECT doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 5 ELSE 2 END AS budget FROM labels")
def _(s, d):
    parts = F.when(F.col("quality") == 0, F.array(F.lit("text"))).when(F.col("toxic") == 1, F.array(F.lit("image"))).otherwise(F.array(F.lit("image"), F.lit("table")))
    return table(s, d, "labels").select("doc_id", A.budget_label(parts).alias("budget"))


@query("r11_image_gather", "WITH x AS (SELECT user_id AS sample, event_id AS rank, unnest(['i' || (event_id % 7), 'i' || (event_id % 3)]) AS path, unnest([0, 1]) AS pos FROM events), f AS (SELECT sample, path, min(rank * 2 + pos) AS o FROM x GROUP BY ALL) SELECT sample, path, row_number() OVER (PARTITION BY sample ORDER BY o) AS position FROM f QUALIFY position <= 4")
def _(s, d):
    name = lambda m: F.concat(F.lit("i"), (F.col("event_id") % m).cast("string"))
    return A.gather_images(table(s, d, "events").select(F.col("user_id").alias("sample"), F.col("event_id").alias("rank"), F.array(name(7), name(3)).alias("images")), 4).withColumn("position", F.col("position").cast("long"))
