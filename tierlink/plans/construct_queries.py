"""Catalogue of media facts, linking, vector indexes, components, message passing variants and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.functions import hooks
from tierlink.functions import text as T
from tierlink.operators import build as B
from tierlink.operators import graph as G
from tierlink.operators import micro as MI
from tierlink.operators import pattern as P
from tierlink.operators import prompts as A
from tierlink.operators import rank as R
from tierlink.operators import vectors as VX
from tierlink.plans import build_queries, graph_queries, rank_queries, text_queries
from tierlink.plans import views as V
from tierlink.plans.components import component
from tierlink.session import materialize, shared_dir, table
from tierlink.sources import encode

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# -- media facts --------------------------------------------------------------------------------------
def _media(s, d):
    """Documents with an image each (pages) or a table of one row (parts)."""
    image = F.struct(F.concat(F.lit("img_"), "page_id").alias("image_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"))
    row = F.create_map(F.lit("p_name"), F.col("p_name"), F.lit("p_brand"), F.col("p_brand"), F.lit("p_type"), F.col("p_type"))
    tab = F.struct(F.lit("part").alias("table_id"), F.array(F.lit("p_name"), F.lit("p_brand"), F.lit("p_type")).alias("schema"), F.array(row).alias("rows"))
    docs = table(s, d, "pages").select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.array(image).alias("images"))
    return docs.unionByName(table(s, d, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("doc_id"), F.array(tab).alias("tables")), allowMissingColumns=True).withColumn("title", F.lit(None).cast("string"))


M01 = f"""WITH r AS (SELECT 'part_' || p_partkey AS doc_id, 'table' AS modality, p_name AS head, 'p_brand' AS relation, p_brand AS tail, 'part#row0' AS source_ref FROM part UNION ALL SELECT 'part_' || p_partkey, 'table', p_name, 'p_type', p_type, 'part#row0' FROM part
UNION ALL SELECT 'page_' || page_id, 'image', 'img_' || page_id, 'describes', regexp_extract(html, '<title>([^<]*)</title>', 1), 'img_' || page_id FROM pages),
n AS (SELECT doc_id, modality, source_ref, {V.NORM.format('head')} AS h, {V.NORM.format('relation')} AS r, {V.NORM.format('tail')} AS t FROM r)
SELECT md5(concat_ws('|', doc_id, modality, h, r, t, source_ref)) AS triple_id, h AS head, r AS relation, t AS tail, modality, doc_id FROM n WHERE h <> '' AND r <> '' AND t <> ''"""


@query("m01_micro_graph", M01)
def _(s, d):
    """Half of the items come from the cache of an earlier run, which also holds one of a document that is gone."""
    items, extract = MI.media_items(_media(s, d)), component("extractor", "media")
    gone = s.createDataFrame([("gone", "image", '{"image_id":"x","caption":"y"}')], items.schema)
    early = materialize(MI.micro_graph(items.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).unionByName(gone), extract))
    return MI.micro_graph(items, extract, early).select("triple_id", "head", "relation", "tail", "modality", "doc_id")


@query("x04_extractor_by_name", M01.replace("SELECT md5(", "SELECT doc_id, modality, source_ref, h AS head, md5(").replace(" AS triple_id, h AS head, r AS relation, t AS tail, modality, doc_id FROM n", " AS triple_id FROM n"))
def _(s, d):
    return MI.micro_graph(MI.media_items(_media(s, d)), component("extractor", "media")).select("doc_id", "modality", "source_ref", "head", "triple_id")


MACRO = build_queries.ALIGN + ", cand AS (SELECT DISTINCT t AS mention, {brand} AS entity, CASE length(p_type) % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.7 END::DOUBLE AS norm_score FROM (SELECT *, {type} AS t FROM part))".format(brand=V.NORM.format("p_brand"), type=V.NORM.format("p_type"))
NEAR = MACRO + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY norm_score DESC, entity) AS n FROM cand) WHERE n <= 3 AND norm_score >= 0.75)"


def _near(s, d):
    """Brands as the near candidates of types, which are no macro entities."""
    k = F.length("p_type") % 3
    score = F.when(k == 0, 0.9).when(k == 1, 0.75).otherwise(0.7)
    return table(s, d, "part").select(T.normalize_phrase("p_type").alias("mention"), T.normalize_phrase("p_brand").alias("entity"), score.alias("norm_score")).distinct()


@query("j05_cross_tier_near", f"WITH {NEAR}, ends AS (SELECT triple_id, head AS e FROM v_micro_norm UNION SELECT triple_id, tail FROM v_micro_norm) SELECT triple_id, entity FROM v_align UNION SELECT triple_id, entity FROM ends JOIN best ON e = mention WHERE e NOT IN (SELECT entity FROM v_macro)")
def _(s, d):
    return B.cross_tier(V.micro_normalized(s, d), build_queries._macro(s, d), _near(s, d))


@query("j06_described_linking", f"WITH {NEAR}, ds AS (SELECT 'part_' || p_partkey AS doc_id, {V.NORM.format('p_brand')} AS m FROM part UNION SELECT 'part_' || p_partkey, {V.NORM.format('p_type')} FROM part) SELECT doc_id, m AS entity FROM ds WHERE m IN (SELECT entity FROM v_macro) UNION SELECT doc_id, entity FROM ds JOIN best ON m = mention WHERE m NOT IN (SELECT entity FROM v_macro) AND entity IN (SELECT entity FROM v_macro)")
def _(s, d):
    mentions = table(s, d, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("doc_id"), F.explode(F.array("p_brand", "p_type", F.lit(" "))).alias("mention"))
    return MI.link_described(mentions, build_queries._macro(s, d), _near(s, d))


NAMED = "SELECT n_nationkey, 'From ' || n_name || ' to ' || r_name || ' by sea' AS text, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _named(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.concat(F.lit("From "), "n_name", F.lit(" to "), "r_name", F.lit(" by sea")).alias("text"), "n_name", "r_name")


@query("m02_described_mentions", f"WITH x AS ({NAMED}) SELECT n_nationkey AS doc_id, unnest(['From ' || n_name, r_name]) AS mention FROM x")
def _(s, d):
    return MI.described_mentions(_named(s, d).select(F.col("n_nationkey").alias("doc_id"), F.col("text").alias("description")).unionByName(s.range(1).select(F.lit(1).cast("int").alias("doc_id"), F.lit(" ").alias("description")), allowMissingColumns=True))


@query("x01_recognition_hook", f"WITH x AS ({NAMED}) SELECT n_nationkey, unnest(['From ' || n_name, r_name]) AS name FROM x")
def _(s, d):
    return _named(s, d).select("n_nationkey", F.explode(hooks.apply("ner", "text")).alias("name"))


@query("x02_extraction_hook", f"WITH x AS ({NAMED}) SELECT n_nationkey, n_name AS head, 'borders' AS relation, r_name AS tail FROM x")
def _(s, d):
    t = _named(s, d).select("n_nationkey", F.explode(hooks.apply("openie", F.concat("n_name", F.lit(" borders "), "r_name"))).alias("t"))
    return t.select("n_nationkey", F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"))


@query("x07_embedding_hook", "SELECT DISTINCT p_brand AS name, 64 AS size, 1.0::DOUBLE AS length FROM part")
def _(s, d):
    e = table(s, d, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("v", hooks.apply("embed", "name"))
    return e.select("name", F.size("v").alias("size"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("length"))


@query("x08_generation_hook", "SELECT s_suppkey, 'Answer: ' || s_name AS response FROM supplier")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", hooks.apply("generate", F.concat(F.lit("Who?\n"), "s_name")).alias("response"))


@query("m03_passage_entities", "WITH l AS (SELECT source AS doc_id, arg_max(doc_id, doc_id) AS id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1) SELECT doc_id, unnest([lang, 'e' || id]) AS entity FROM l WHERE id % 5 <> 0")
def _(s, d):
    e = F.when(F.col("doc_id") % 5 != 0, F.array(F.col("lang"), F.concat(F.lit("e"), F.col("doc_id").cast("string"))))
    return MI.entities_of_passages(table(s, d, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("title"), e.alias("entities")))


@query("m06_index_tables", f"WITH {build_queries.ENCODED} SELECT 'node' AS kind, id, name, 64 AS size FROM ent UNION ALL SELECT 'relation', id, name, 64 FROM rel")
def _(s, d):
    nodes, relations = MI.index_tables(V.triples(s, d))
    return nodes.withColumn("kind", F.lit("node")).unionByName(relations.withColumn("kind", F.lit("relation"))).select("kind", "id", "name", F.size("v").alias("size"))


@query("m07_extracted_triples", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 1 THEN '' ELSE p_brand || '|makes|' || p_partkey END AS triple FROM part")
def _(s, d):
    k = F.col("p_partkey") % 4
    good = F.concat(F.lit('Sure: {"triples": [["'), "p_brand", F.lit('", "makes", "'), F.col("p_partkey").cast("string"), F.lit('"]]} done'))
    x = table(s, d, "part").select("p_partkey", F.when(k == 0, "{}").when(k == 1, "no answer").otherwise(good).alias("answer"))
    return MI.extracted_triples(x).select("p_partkey", F.coalesce(F.array_join(F.get("triples", F.lit(0)), "|"), F.lit("")).alias("triple"))


@query("p15_decode_paths", f"WITH {V.TRIPLES} SELECT head, relation, tail FROM v_triples")
def _(s, d):
    t = V.triples(s, d)
    ent, rel = encode.dictionaries(t)
    return encode.decode_path(encode.encode_edges(t, ent, rel), ent, rel).select("head", "relation", "tail")


# -- vectors --------------------------------------------------------------------------------------------
@query("v02_approximate_recall", "SELECT count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(s, d):
    """Recall of 10 neighbours against exact search, for all queries, with as many cells as a sample asks for."""
    queries, index = graph_queries._vectors(s, d)
    centres = VX.fit_cells(index, 32)
    found = VX.approximate(queries, VX.in_cells(index, centres), centres, 10, VX.probes_for(index, centres, 10, 0.95))
    return queries.agg(F.count("*").alias("n")).crossJoin(VX.recall(found, G.nearest(queries, index, 10))).select("n", (F.col("recall") >= 0.9).alias("enough"))


@query("v02_all_cells", f"WITH {graph_queries.PAIRS}, s AS (SELECT q, name, {graph_queries.L2} AS score FROM q, x) SELECT q, name, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9), name) AS rank FROM s QUALIFY rank <= 5")
def _(s, d):
    queries, index = graph_queries._vectors(s, d)
    centres = VX.fit_cells(index, 16)
    return VX.approximate(queries, VX.in_cells(index, centres), centres, 5, 16).select("q", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


V05 = """q AS (SELECT vec_id // 5 AS q, vec_id % 5 AS token, embedding::DOUBLE[] AS a FROM embeddings WHERE (vec_id // 5) % 100 = 0), x AS (SELECT vec_id // 5 AS name, embedding::DOUBLE[] AS b FROM embeddings),
p AS (SELECT q, token, name, max(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))) AS m FROM q, x GROUP BY ALL), s AS (SELECT q, name, sum(m) AS score FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, name) AS rank FROM s QUALIFY rank <= 5)"""


@query("v05_late_interaction", f"WITH {V05} SELECT q, name, rank, round(score / max(score) OVER (PARTITION BY q), 6) AS norm_score FROM r")
def _(s, d):
    e = table(s, d, "embeddings")
    phrase = F.floor(F.col("vec_id") / 5)
    index = e.select(phrase.alias("name"), F.col("embedding").alias("v"))
    queries = e.where(phrase % 100 == 0).select(phrase.alias("q"), (F.col("vec_id") % 5).alias("token"), F.col("embedding").alias("v"))
    return VX.late_interaction(queries, index, 5).select("q", "name", F.col("rank").cast("long").alias("rank"), F.round("norm_score", 6).alias("norm_score"))


@query("x03_linker_by_name", graph_queries.LINK + " SELECT q, name, rank, round(norm_score, 6) AS norm_score FROM n")
def _(s, d):
    return component("linker", "dense")(*graph_queries._vectors(s, d), 5).select("q", "name", F.col("rank").cast("long").alias("rank"), F.round("norm_score", 6).alias("norm_score"))


@query("v06_cached_vectors", "SELECT DISTINCT p_brand AS name, 64 AS size FROM part")
def _(s, d):
    names, root = table(s, d, "part").select(F.col("p_brand").alias("name")), f"{shared_dir(s)}/vectors"
    VX.cached_vectors(names, root)  # the first call fills the cache, the second reads it
    return VX.cached_vectors(names.orderBy(F.desc("name")), root).select("name", F.size("v").alias("size"))


@query("v07_instructed_text", "SELECT p_partkey, 'query: ' || p_name || '</s>' AS query, 'passage: ' || p_name || '</s>' AS passage FROM part")
def _(s, d):
    make = lambda q: VX.instructed("p_name", q, "query: ", "passage: ", "</s>")
    return table(s, d, "part").select("p_partkey", make(True).alias("query"), make(False).alias("passage"))


@query("k15_stored_index", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 UNION ALL SELECT NULL, 0")
def _(s, d):
    """Stored in two inserts and loaded; the row without a label counts what a reset index holds."""
    path = f"{shared_dir(s)}/index-{abs(hash(d))}"
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("v"), "label")
    VX.reset_vectors(s, path)
    empty = VX.load_vectors(s, path).agg(F.count("*").alias("n"))
    VX.insert_vectors(e.where("vec_id % 2 = 0"), path)
    VX.insert_vectors(e.where("vec_id % 2 = 1"), path)
    loaded = VX.load_vectors(s, path).join(e.select("name", "label"), "name").groupBy("label").agg(F.count("*").alias("n"))
    return loaded.unionByName(empty.select(F.lit(None).cast(e.schema["label"].dataType).alias("label"), "n"))


# -- components by name ------------------------------------------------------------------------------------
@query("x05_matcher_by_name", ORACLE_SQL.get("") or graph_queries.ORACLE_SQL["g01_pattern_1edge"])
def _(s, d):
    m = component("matcher", "pattern")([("nation_1", "in region", "asia")], *graph_queries._candidates(s, d), k=20)
    return m.select(F.round("score", 6).alias("score"), "edges")


@query("x06_ranker_by_name", rank_queries.A04)
def _(s, d):
    return rank_queries._ranked(component("ranker", "idf_topk")(*rank_queries._seeded(s, d)))


@query("x09_loss_by_name", rank_queries.ORACLE_SQL["a30_listce_loss"])
def _(s, d):
    return component("loss", "list_ce")(rank_queries._logits(s, d)).select(F.round("loss", 9).alias("loss"))


@query("x10_evaluator_by_name", text_queries.ORACLE_SQL["a26_em_f1_summary"])
def _(s, d):
    m = component("evaluator", "answers")(V.predictions(s, d))
    return m.select(*[F.round(c, 6).alias(c) for c in ("em", "f1", "precision", "recall")])


@query("x11_constructor_by_name", "SELECT DISTINCT regexp_replace(lower(n_name), '[^a-z0-9 ]', ' ', 'g') AS head, 'in region' AS relation, lower(r_name) AS tail FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    n = _named(s, d).select(F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("seq"), F.col("n_nationkey").cast("string").alias("doc_id"), F.array("n_name", F.lit("in region"), "r_name").alias("items"))
    facts = V.micro(s, d).where("false")
    index = component("constructor", "default")(n, facts, n.select("doc_id"), n.select("doc_id").where("false"))
    return index.edges.select("head", "relation", "tail")


# -- message passing and patterns -------------------------------------------------------------------------
ROT = graph_queries.WITH_B + """, z AS (SELECT node, max(CASE WHEN dim = 0 THEN x END) AS a, max(CASE WHEN dim = 1 THEN x END) AS b FROM x GROUP BY 1), q AS (SELECT rel, max(CASE WHEN dim = 0 THEN r END) AS c, max(CASE WHEN dim = 1 THEN r END) AS f FROM rl GROUP BY 1),
t AS (SELECT e.tail AS node, unnest([0, 1]) AS dim, unnest([a * c - b * f, a * f + b * c]) AS m FROM e JOIN z ON e.head = z.node JOIN q ON q.rel = e.relation UNION ALL SELECT node, dim, x + 0.5 FROM x)"""


@query("g07_rotate", ROT + " SELECT node, dim, round(sum(m), 6) AS x FROM t GROUP BY ALL")
def _(s, d):
    e, x, r = graph_queries._state(s, d)
    return G.aggregate_messages(e, x, r, graph_queries._boundary(x), "sum", "rotate", 2).select("node", "dim", F.round("x", 6).alias("x"))


def _weights(s, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """Weights ((3 in + 7 out) mod 5 - 2) / 10 and biases out / 20 of a dense layer."""
    w = s.range(rows).select(F.col("id").cast("int").alias("dim")).crossJoin(s.range(columns).select(F.col("id").cast("int").alias("out")))
    return w.withColumn("w", ((F.col("dim") * 3 + F.col("out") * 7) % 5 - 2).cast("double") / 10), s.range(columns).select(F.col("id").cast("int").alias("out"), (F.col("id") / 20).alias("b"))


def _dense(x, rows, columns, relu):
    value = f"sum(x * (((i * 3 + o * 7) % 5) - 2)::DOUBLE / 10) + o / 20.0::DOUBLE"
    return f"(SELECT node, o AS i, {'greatest(' + value + ', 0)' if relu else value} AS x FROM {x}, (SELECT unnest(generate_series(0, {columns - 1})) AS o) GROUP BY node, o)"


MLP = graph_queries.STATE + ", inp AS (SELECT node, dim AS i, x FROM x UNION ALL SELECT DISTINCT node, dim + 2, dim + 0.5::DOUBLE FROM x)"


@query("g08_mlp_score", MLP + f" SELECT node, round(x, 6) AS score FROM {_dense(_dense('inp', 4, 3, True), 3, 1, False)}")
def _(s, d):
    _, x, _ = graph_queries._state(s, d)
    q = s.range(2).select(F.col("id").cast("int").alias("dim"), (F.col("id") + 0.5).alias("q"))
    return G.score_nodes(x, q, 2, [_weights(s, 4, 3), _weights(s, 3, 1)]).select("node", F.round("score", 6).alias("score"))


@query("g21_score_triples", graph_queries.STATE.replace("e AS (SELECT DISTINCT head, relation, tail FROM v_triples)", "ea AS (SELECT DISTINCT head, relation, tail FROM v_triples), e AS (SELECT * FROM ea WHERE tail <> 'asia')") + ", b0 AS (SELECT node, dim, x + 0.5 AS x FROM x)" + graph_queries._layer(1, "b0") + " SELECT node, round(sum(x * (dim + 1)), 5) AS score FROM x1 GROUP BY node")
def _(s, d):
    every = graph_queries._triples(s, d)
    batch = every.where("tail = 'asia'")
    _, x, rel = graph_queries._state(s, d)
    known = every.where("tail <> 'asia'").select(F.explode(F.array("head", "tail")).alias("node")).distinct()
    q = s.range(2).select(F.col("id").cast("int").alias("dim"), (F.col("id") + 1).cast("double").alias("q"))
    got = G.score_triples(every, batch, graph_queries._boundary(x.join(known, "node", "left_semi")), rel, q, 1)
    return got.select("node", F.round("score", 5).alias("score"))


@query("g02_adjacency", f"WITH {V.TRIPLES}, e AS (SELECT DISTINCT head, relation, tail FROM v_triples) SELECT src, rel, dst, min(p) AS penalty FROM (SELECT head AS src, relation AS rel, tail AS dst, 0.0::DOUBLE AS p FROM e UNION ALL SELECT tail, relation, head, 0.25 FROM e) GROUP BY ALL")
def _(s, d):
    return P.adjacency(V.triples(s, d), True)


@query("g03_edge_order", "SELECT row_number() OVER (ORDER BY -c, r_name, n_name NULLS FIRST)::INT - 1 AS position, CASE WHEN n_name IS NULL THEN 'world' ELSE r_name END AS source, CASE WHEN n_name IS NULL THEN 'part' ELSE 'nation' END AS relation, coalesce(n_name, r_name) AS target FROM (SELECT r_name, unnest(list_append(list(n_name), NULL)) AS n_name, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)")
def _(s, d):
    """The pattern of all regions and their nations from one root: regions by degree, each followed by its nations."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()
    edges = [("world", "part", r) for r in sorted({x["r_name"] for x in n})] + [(x["r_name"], "nation", x["n_name"]) for x in n]
    return s.createDataFrame([(i, *e) for i, e in enumerate(P.edge_order(edges, "world"))], "position int, source string, relation string, target string")


def _one_edge(s, d):
    return [("nation_1", "in region", "asia")], *graph_queries._candidates(s, d)


@query("g04_best_score", graph_queries.ORACLE_SQL["g01_pattern_1edge"].replace("SELECT score, edges FROM m ORDER BY score, reuse, edges LIMIT 20", "SELECT 'match' AS kind, round(min(score), 6) AS score FROM m UNION ALL SELECT 'no pattern', 0.0 UNION ALL SELECT 'no match', 'inf'::DOUBLE"))
def _(s, d):
    pattern, facts, names, relations = _one_edge(s, d)
    rows = [("match", P.best_score(pattern, facts, names, relations)), ("no pattern", P.best_score([], facts, names, relations)), ("no match", P.best_score([("UNKNOWN a", "in region", "UNKNOWN b")], facts, names, relations))]
    return s.createDataFrame(rows, "kind string, score double").withColumn("score", F.round("score", 6))


@query("m13_reason_codes", "SELECT * FROM (VALUES ('empty', 'empty_condition_triples'), ('unknown', 'no_similar_root_node'), ('match', '')) t(kind, reason)")
def _(s, d):
    pattern, facts, names, relations = _one_edge(s, d)
    cases = {"empty": [], "unknown": [("UNKNOWN a", "in region", "UNKNOWN b")], "match": pattern}
    return s.createDataFrame([(k, P.match_with_reason(p, facts, names, relations)[1]) for k, p in cases.items()], "kind string, reason string")


# -- prompts --------------------------------------------------------------------------------------------------
def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("t09_prompts", f"SELECT p_partkey, concat_ws(chr(10), {_sql(A.NER_PROMPT)}, {_sql('Text: ' + A.ONE_SHOT[0])}, {_sql(A.ONE_SHOT[1])}, 'Text: ' || p_name) AS ner, concat_ws(chr(10), {_sql(A.OPENIE_PROMPT)}, {_sql('Text: ' + A.ONE_SHOT[0])}, {_sql(A.ONE_SHOT[1])}, {_sql(A.ONE_SHOT[2])}, 'Text: ' || p_name, '{{\"named_entities\":[\"' || p_brand || '\"]}}') AS openie FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", A.ner_prompt(F.col("p_name")).alias("ner"), A.openie_prompt(F.col("p_name"), F.array("p_brand")).alias("openie"))


@query("m09_pattern_prompt", f"SELECT item_id, {_sql(A.PATTERN_PROMPT)} || chr(10) || text AS prompt FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", F.concat(F.lit(A.PATTERN_PROMPT + "\n"), "text").alias("prompt"))


@query("j13_hit_entities", f"WITH {rank_queries.HITS}, a AS (SELECT triple_id, head AS entity FROM v_micro_norm UNION SELECT triple_id, tail FROM v_micro_norm) SELECT DISTINCT sample_id, doc_id, entity FROM hits JOIN v_micro_norm USING (triple_id) JOIN a USING (triple_id)")
def _(s, d):
    m, hits = rank_queries._hits(s, d)
    align = m.select("triple_id", F.explode(F.array("head", "tail")).alias("entity"))
    return hits.join(m.select("triple_id", "doc_id"), "triple_id").join(align, "triple_id").select("sample_id", "doc_id", "entity").distinct()


@query("f05_distance_cut", rank_queries.ORACLE_SQL["a11_node_anchor_score"].replace("distance <= 1.0", "distance <= 0.25"))
def _(s, d):
    m = V.micro_normalized(s, d)
    t = m.where("relation = 'p type'")
    near = [t.select(F.lit(1).alias("sample_id"), F.col(a).alias("anchor"), F.col(n).alias("node"), F.lit(x).alias("distance")).distinct() for a, n, x in (("head", "head", 0.0), ("head", "tail", 0.5), ("tail", "head", 1.5))]
    return R.anchor_doc_scores(reduce(DataFrame.unionByName, near), B.incident_triples(m), m, 0.25).withColumn("score", F.round("score", 6))
