"""Catalogue of samples, retrieval results, contexts, answers and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.operators import answers as AN
from tierlink.operators import build as B
from tierlink.operators import metrics as M
from tierlink.operators import rank as R
from tierlink.plans import pipelines, rank_queries
from tierlink.plans import views as V
from tierlink.session import materialize, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("f06_usable_samples", "WITH x AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN o_custkey % 3 = 0 THEN [] ELSE ['c' || o_custkey, 'c' || (o_custkey + 1), 'c' || o_custkey] END AS q FROM orders), n AS (SELECT sample_id, split, len(list_distinct(list_filter(q, lambda e: e IN (SELECT 'c' || c_custkey FROM customer)))) AS n FROM x) SELECT sample_id, split, n AS n_linked FROM n WHERE split = 'test' OR n > 0".replace("list_filter(q, lambda e: e IN (SELECT 'c' || c_custkey FROM customer))", "list_intersect(q, (SELECT list('c' || c_custkey) FROM customer))"))
def _(s, d):
    c = lambda x: F.concat(F.lit("c"), x.cast("string"))
    q = F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(c(F.col("o_custkey")), c(F.col("o_custkey") + 1), c(F.col("o_custkey"))))
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"), q.alias("question_entities"))
    return AN.usable_samples(x, table(s, d, "customer").select(c(F.col("c_custkey")).alias("entity"))).select("sample_id", "split", F.col("n_linked").cast("long").alias("n_linked"))


@query("p19_one_sample", f"WITH {V.SCORE} SELECT id, score FROM v_score WHERE sample = 'click'")
def _(s, d):
    return AN.one_sample(V.scores(s, d), "click", "sample").select("id", "score")


@query("m23_index_mask", "SELECT p_partkey AS id, (p_partkey IN (SELECT s_suppkey FROM supplier))::INT AS mask FROM part")
def _(s, d):
    return AN.index_mask(table(s, d, "part").select(F.col("p_partkey").alias("id")), table(s, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("m23_group_indices", "SELECT k AS \"group\", unnest(generate_series(0, n - 1)) AS pos FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def _(s, d):
    return AN.group_indices(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("group")).agg(F.count("*").alias("size")))


@query("m14_score_map", "SELECT event_type AS sample_id, 'd' || (user_id % 50) AS doc_id, arg_max(coalesce(CASE WHEN event_id % 11 <> 0 THEN value::DOUBLE END, 0), event_id) AS score FROM events WHERE user_id % 50 <> 7 GROUP BY ALL")
def _(s, d):
    k = F.col("user_id") % 50
    doc = F.when(k == 7, " ").otherwise(F.concat(F.lit(" d"), k.cast("string")))
    score = F.when(F.col("event_id") % 11 != 0, F.col("value").cast("double"))
    return AN.score_map(table(s, d, "events").select(F.col("event_type").alias("sample_id"), F.col("event_id").alias("pos"), doc.alias("doc_id"), score.alias("score")))


R09 = rank_queries.HITS + rank_queries.A11[len(V.MICRO_NORM):] + """, gr AS (SELECT sample_id, doc_id, max(1 / (1 + greatest(0, distance))) AS score FROM hits JOIN v_micro_norm USING (triple_id) WHERE distance <= 3.0 GROUP BY ALL), nd AS (SELECT sample_id, doc_id, sum(s) AS score FROM b GROUP BY ALL),
mg AS (SELECT sample_id, doc_id, round(greatest(max(score), 0), 6) AS score FROM (SELECT * FROM gr UNION ALL SELECT sample_id, doc_id, score * 0.5 FROM nd) GROUP BY ALL)"""


@query("r09_micro_ranking", f"WITH {R09} SELECT sample_id, doc_id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, doc_id) AS rank FROM mg QUALIFY rank <= 20")
def _(s, d):
    m, hits = rank_queries._hits(s, d)
    t = m.where("relation = 'p type'")
    near = None
    for a, n, x in (("head", "head", 0.0), ("head", "tail", 0.5), ("tail", "head", 1.5)):
        part = t.select(F.lit(1).alias("sample_id"), F.col(a).alias("anchor"), F.col(n).alias("node"), F.lit(x).alias("distance")).distinct()
        near = part if near is None else near.unionByName(part)
    return AN.micro_ranking(hits, near, B.incident_triples(m), m, 3.0, 1.0, 0.5).select("sample_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("w10_scaled_top", f"WITH {V.SCORE}, b AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM v_score WINDOW w AS (PARTITION BY sample)) SELECT sample AS sample_id, id AS doc_id, round((score - lo) / (hi - lo), 9) AS norm_score, row_number() OVER (PARTITION BY sample ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 5")
def _(s, d):
    x = V.scores(s, d).select(F.col("sample").alias("sample_id"), F.col("id").alias("doc_id"), "score")
    return AN.scaled_top(x, 5).select("sample_id", "doc_id", F.round("norm_score", 9).alias("norm_score"), F.col("rank").cast("long").alias("rank"))


@query("w11_saved_entities", f"WITH {V.SEEDS} SELECT sample_id, entity, w FROM v_seed QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY w DESC, entity) <= 10")
def _(s, d):
    return R.best_entities(V.seeds(s, d), 10)


TRACE = "t AS (SELECT event_id AS id, event_id % 7 <> 0 AS parsed, event_id % 4 AS n_condition, event_id % 13 = 0 AS failed, user_id % 5 AS n_seeds, least(user_id % 5, 2) AS n_in_graph, event_id % 6 AS n_before, event_id % 6 + user_id % 3 AS n_after FROM events)"


@query("a33_activation_counters", f"WITH {TRACE} SELECT count(*) AS total_samples, sum(parsed::INT)::BIGINT AS parse_success, sum((NOT parsed)::INT)::BIGINT AS parse_fail, sum((parsed AND n_condition > 0)::INT)::BIGINT AS condition_nonempty, sum((parsed AND n_condition = 0)::INT)::BIGINT AS condition_empty, sum(failed::INT)::BIGINT AS activation_fail, sum((n_seeds > 0)::INT)::BIGINT AS extra_seed_nonempty, sum((n_seeds = 0)::INT)::BIGINT AS extra_seed_empty, sum((n_after > n_before)::INT)::BIGINT AS mask_expanded, sum((n_after <= n_before)::INT)::BIGINT AS mask_unchanged, sum(n_seeds)::BIGINT AS seed_total, sum(n_in_graph)::BIGINT AS seed_in_graph_total, sum(n_seeds - n_in_graph)::BIGINT AS seed_oov_total, sum(n_after - n_before)::BIGINT AS mask_delta_total, max(n_after - n_before)::BIGINT AS mask_delta_max FROM t")
def _(s, d):
    e, u = F.col("event_id"), F.col("user_id")
    x = table(s, d, "events").select((e % 7 != 0).alias("parsed"), (e % 4).alias("n_condition"), (e % 13 == 0).alias("failed"), (u % 5).alias("n_seeds"), F.least(u % 5, F.lit(2)).alias("n_in_graph"), (e % 6).alias("n_before"), (e % 6 + u % 3).alias("n_after"))
    return AN.activation_counters(x)


@query("a33_stage_timers", "SELECT event_type AS stage, count(*) AS n, round(sum(value::DOUBLE), 4) AS total_s, round(avg(value::DOUBLE), 6) AS mean_s FROM events GROUP BY 1")
def _(s, d):
    t = AN.stage_timers(table(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").cast("double").alias("seconds")))
    return t.select("stage", "n", F.round("total_s", 4).alias("total_s"), F.round("mean_s", 6).alias("mean_s"))


@query("w20_ordered_results", "SELECT doc_id, quality FROM labels ORDER BY doc_id")
def _(s, d):
    return AN.ordered_results(table(s, d, "labels").select("doc_id", "quality"), "doc_id")


@query("p12_table_text", "SELECT p_partkey, 'brand | type' || chr(10) || p_brand || ' | ' || p_type || chr(10) || p_name || ' | ' AS text FROM part")
def _(s, d):
    names = F.array(F.lit("brand"), F.lit("type"))
    rows = F.array(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand")), F.create_map(F.lit("brand"), F.col("p_name"), F.lit("other"), F.col("p_type")))
    return table(s, d, "part").select("p_partkey", AN.table_text(names, rows).alias("text"))


@query("t05_alias_map", "WITH t AS (SELECT n_regionkey AS sample, n_name AS doc, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank, n_nationkey FROM nation), a AS (SELECT sample, doc, rank FROM t UNION ALL SELECT sample, 'id' || (n_nationkey // 2), rank FROM t) SELECT sample, doc, 'doc' || max(rank) AS alias FROM a GROUP BY ALL")
def _(s, d):
    from pyspark.sql import Window

    n = table(s, d, "nation")
    top = n.select(F.col("n_regionkey").alias("sample"), F.col("n_name").alias("doc"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("rank"))
    return AN.alias_map(top, n.select(F.col("n_name").alias("doc"), F.concat(F.lit("id"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("doc_id")))


@query("r12_media_context", f"SELECT p_partkey, concat_ws(chr(10), '{AN.CONTEXT_HEAD}', 'Question: ' || p_name, 'Document 1: ' || p_brand || chr(10) || p_type, 'Document 2: ' || p_type || chr(10) || p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'Image 1 (image, d' || p_partkey || '): ' || p_brand || '; ' || p_type END, '{AN.CONTEXT_END}') AS prompt FROM part")
def _(s, d):
    docs = F.array(F.struct(F.col("p_brand").alias("title"), F.col("p_type").alias("content")), F.struct(F.col("p_type").alias("title"), F.col("p_brand").alias("content")))
    one = F.array(F.struct(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doc_id"), F.lit("image").alias("modality"), F.col("p_brand").alias("title"), F.col("p_type").alias("caption")))
    media = F.filter(one, lambda _: F.col("p_partkey") % 2 == 0)
    return table(s, d, "part").select("p_partkey", AN.media_context(F.col("p_name"), docs, media).alias("prompt"))


@query("r12_media_items", "WITH x AS (SELECT n_regionkey AS sample, n_nationkey AS rank, 'd' || n_nationkey AS doc_id, unnest(['image', 'table_image']) AS modality, unnest(['p' || (n_nationkey % 4), 't' || (n_nationkey % 3)]) AS path FROM nation), f AS (SELECT sample, path, min(rank * 100 + (modality <> 'image')::INT * 10) AS o, arg_min(doc_id, rank * 100 + (modality <> 'image')::INT * 10) AS doc_id, arg_min(modality, rank * 100 + (modality <> 'image')::INT * 10) AS modality FROM x GROUP BY ALL) SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY o, path) AS position, doc_id, modality, path FROM f")
def _(s, d):
    n = table(s, d, "nation")
    key = F.concat(F.lit("d"), F.col("n_nationkey").cast("string"))
    docs = n.select(F.col("n_regionkey").alias("sample"), F.col("n_nationkey").alias("rank"), key.alias("doc_id"))
    name = lambda p, m: F.concat(F.lit(p), (F.col("n_nationkey") % m).cast("string"))
    images = n.select(key.alias("doc_id"), F.lit("image").alias("modality"), name("p", 4).alias("path")).unionByName(n.select(key.alias("doc_id"), F.lit("table_image").alias("modality"), name("t", 3).alias("path")))
    return AN.media_items_of(docs, images).withColumn("position", F.col("position").cast("long"))


M12 = "m AS (SELECT doc_id AS id, lang AS subject, doc_id % 5 AS answer, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr('ABCDE', (doc_id % 3 + 1)::INT, 1) END AS parsed_letter, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id % 3 END AS parsed_index FROM documents), k AS (SELECT *, parsed_index >= 0 AND parsed_index = answer AS is_correct FROM m)"


def _marked(s, d):
    letter = F.substring(F.lit("ABCDE"), 1, 1)
    letter = F.when(F.col("doc_id") % 3 == 1, "B").when(F.col("doc_id") % 3 == 2, "C").otherwise(letter)
    response = F.when(F.col("doc_id") % 7 == 0, "none of these").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ANSWER: "), letter)).otherwise(letter)
    return AN.marked_answers(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), (F.col("doc_id") % 5).alias("answer"), response.alias("response")))


@query("m12_answer_run", f"WITH {M12} SELECT id, parsed_letter, parsed_index::INT AS parsed_index, is_correct FROM k")
def _(s, d):
    return _marked(s, d).select("id", "parsed_letter", "parsed_index", "is_correct")


@query("m12_answer_summary", f"WITH {M12} SELECT subject, count(*) AS n, sum(is_correct::INT)::BIGINT AS n_correct, round(avg(is_correct::INT), 9) AS accuracy FROM k GROUP BY GROUPING SETS ((), (subject))")
def _(s, d):
    m = AN.answer_summary(_marked(s, d), ["subject"])
    return m.select("subject", "n", "n_correct", F.round("accuracy", 9).alias("accuracy"))


@query("f11_samples_without_targets", f"WITH {V.SCORE}, l AS (SELECT sample, target, 1 / (1 + exp(-(score - 20) / 10)) AS s FROM v_score WHERE sample <> 'click' UNION ALL SELECT sample, 0, 1 / (1 + exp(-(score - 20) / 10)) FROM v_score WHERE sample = 'click'), t AS (SELECT *, sum(s) OVER (PARTITION BY sample) AS t FROM l), r AS (SELECT sample, avg(-ln(s / (t + 1e-5) + 1e-5)) AS loss FROM t WHERE target = 1 GROUP BY sample) SELECT round(avg(loss), 9) AS loss FROM r")
def _(s, d):
    x = rank_queries._logits(s, d).withColumn("target", F.when(F.col("sample") == "click", 0).otherwise(F.col("target")))
    return M.list_ce_loss(x, ["sample"]).select(F.round("loss", 9).alias("loss"))


# -- retrieval of all samples, and answers -----------------------------------------------------------------
R05 = rank_queries.BEST.format(k=20) + """, tx AS (SELECT doc_id, entity FROM v_doc_ent WHERE doc_id % 4 <> 0), im AS (SELECT doc_id, entity FROM v_doc_ent WHERE doc_id % 4 = 0), dfs AS (SELECT doc_id % 4 = 0 AS i, entity, 1.0::DOUBLE / count(*) AS idf FROM v_doc_ent GROUP BY ALL),
al AS (SELECT i.item_id AS sample_id, d.doc_id, d.doc_id % 4 = 0 AS is_image FROM benchmark i, documents d),
sc AS (SELECT b.sample_id, v.doc_id, sum(f.idf) AS s FROM best b JOIN v_doc_ent v USING (entity) JOIN dfs f ON f.entity = v.entity AND f.i = (v.doc_id % 4 = 0) GROUP BY ALL),
dn AS (SELECT al.*, CASE WHEN is_image THEN 0 ELSE coalesce(s, 0) END AS ts, CASE WHEN is_image THEN coalesce(s, 0) ELSE 0 END AS iv FROM al LEFT JOIN sc USING (sample_id, doc_id) WHERE sample_id IN (SELECT sample_id FROM sc)),
nm AS (SELECT *, min(ts) OVER w AS tl, max(ts) OVER w AS th, min(iv) OVER w AS il, max(iv) OVER w AS ih FROM dn WINDOW w AS (PARTITION BY sample_id)),
fu AS (SELECT sample_id, doc_id, is_image, round(greatest(CASE WHEN th - tl <= 1e-8 THEN 0 ELSE (ts - tl) / (th - tl) END, CASE WHEN ih - il <= 1e-8 THEN 0 ELSE (iv - il) / (ih - il) END), 9) AS merged FROM nm),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY merged DESC, doc_id) AS rank FROM fu), ca AS (SELECT *, is_image AND sum(is_image::INT) OVER (PARTITION BY sample_id ORDER BY rank) > 1 AS late FROM rk)"""


def _index(s, d) -> tuple[pipelines.Index, object, object]:
    de = materialize(V.doc_entities(s, d))
    none = de.where("false")
    index = pipelines.Index(none, none, none, de.where("doc_id % 4 <> 0"), de.where("doc_id % 4 = 0"), none)
    return index, V.seeds(s, d, de), table(s, d, "documents").select("doc_id", (F.col("doc_id") % 4 == 0).alias("is_image"))


@query("r05_retrieve_all", f"WITH {R05} SELECT sample_id, doc_id, round(merged, 6) AS merged, row_number() OVER (PARTITION BY sample_id ORDER BY late, rank) AS position FROM ca QUALIFY position <= 5")
def _(s, d):
    index, seeds, docs = _index(s, d)
    got = pipelines.rank_documents(R.best_entities(seeds, 20), index, 5, 20, 1, docs=docs)
    return got.select("sample_id", "doc_id", F.round("merged", 6).alias("merged"), F.col("position").cast("long").alias("position"))


SPARSE = """few AS (SELECT 1 AS sample_id, 3 AS doc_id, 2.0::DOUBLE AS ts, 0.0::DOUBLE AS iv UNION ALL SELECT 1, 8, 0.0, 1.0), al AS (SELECT 1 AS sample_id, doc_id, doc_id % 4 = 0 AS is_image FROM documents), dn AS (SELECT al.*, coalesce(ts, 0) AS ts, coalesce(iv, 0) AS iv FROM al LEFT JOIN few USING (sample_id, doc_id)),
fu AS (SELECT sample_id, doc_id, is_image, greatest(ts / 2, iv) AS merged FROM dn), rk AS (SELECT *, row_number() OVER (ORDER BY merged DESC, doc_id) AS rank FROM fu), ca AS (SELECT *, is_image AND sum(is_image::INT) OVER (ORDER BY rank) > 1 AS late FROM rk)"""


@query("r01_fewer_than_k", f"WITH {SPARSE} SELECT sample_id, doc_id, merged, row_number() OVER (ORDER BY late, rank) AS position FROM ca QUALIFY position <= 6")
def _(s, d):
    """Two documents are reached, six asked for: the others count with scores of 0 and fill the selection."""
    few = s.createDataFrame([(1, 3, 2.0, 0.0, False), (1, 8, 0.0, 1.0, True)], "sample_id int, doc_id long, text_score double, image_score double, is_image boolean")
    docs = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 4 == 0).alias("is_image"))
    return R.fuse(few, 6, 1, docs=docs).select("sample_id", "doc_id", "merged", F.col("position").cast("long").alias("position"))


@query("g22_retriever", "SELECT s_suppkey AS sample_id, 1 AS position, lower(s_name) || ' doc' AS doc_id FROM supplier")
def _(s, d):
    """Each supplier's name as a question finds the document that has it as an entity; names are recognised by none, so the question is the mention."""
    own = T.normalize_phrase("s_name")
    de = table(s, d, "supplier").select(F.concat(F.lower("s_name"), F.lit(" doc")).alias("doc_id"), own.alias("entity"))
    none = de.where("false")
    index = pipelines.Index(none, none, none, de, none, none)
    q = table(s, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.lower("s_name").alias("question"))
    return pipelines.retrieve(q, index, top_k=1).select("sample_id", "position", "doc_id")


@query("r06_predictions", "SELECT s_suppkey AS sample_id, s_nationkey || ',' || ((s_nationkey + 1) % 25) AS docs, a.n_name || chr(10) || b.n_name || chr(10) || 'Question: ' || s_name AS prompt, 'Answer: Question: ' || s_name AS response FROM supplier JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = (s_nationkey + 1) % 25")
def _(s, d):
    sup = table(s, d, "supplier")
    found = sup.select(F.col("s_suppkey").alias("sample_id"), F.posexplode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 1) % 25)).alias("position", "doc_id"))
    contents = table(s, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("content"))
    p = pipelines.predict_answers(sup.select(F.col("s_suppkey").alias("sample_id"), F.col("s_name").alias("question")), found, contents)
    return p.select("sample_id", F.array_join("retrieved_docs", ",").alias("docs"), F.regexp_replace("prompt", "^\n", "").alias("prompt"), "response")
