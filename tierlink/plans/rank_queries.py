"""Catalogue of ranking, fusion, selection, metrics and losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.functions.numeric import is_close, min_max, softmax
from tierlink.operators import metrics as M
from tierlink.operators import rank as R
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


IDF = V.SEEDS + ", idf AS (SELECT entity, 1.0::DOUBLE / count(*) AS idf FROM v_doc_ent GROUP BY entity)"
BEST = IDF + ", best AS (SELECT * FROM v_seed QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY w DESC, entity) <= {k})"


@query("a01_idf", f"WITH {IDF} SELECT entity, idf FROM idf")
def _(s, d):
    return R.idf(V.doc_entities(s, d))


def _ranked(scores, k=5):
    x = scores.withColumn("score", F.round("score", 6))
    return R.top_k(x, ["sample_id"], k, "score", "doc_id").select("sample_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _seeded(s, d):
    """(seeds, document-entity table), the latter written once, as every ranking reads it more than once."""
    docs = materialize(V.doc_entities(s, d))
    return V.seeds(s, d, docs), docs


def _rank_sql(body, cte=IDF):
    return f"WITH {cte}, r AS ({body}), q AS (SELECT sample_id, doc_id, round(score, 6) AS score FROM r) SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, doc_id) AS rank FROM q QUALIFY rank <= 5"


@query("j04_simple_rank", _rank_sql("SELECT sample_id, doc_id, sum(w) AS score FROM v_seed JOIN v_doc_ent USING (entity) GROUP BY ALL"))
def _(s, d):
    return _ranked(R.simple_rank(*_seeded(s, d)))


@query("a02_idf_rank", _rank_sql("SELECT sample_id, doc_id, sum(w * idf) AS score FROM v_seed JOIN idf USING (entity) JOIN v_doc_ent USING (entity) GROUP BY ALL"))
def _(s, d):
    return _ranked(R.idf_rank(*_seeded(s, d)))


@query("a03_topk_rank", _rank_sql("SELECT sample_id, doc_id, count(*)::DOUBLE AS score FROM best JOIN v_doc_ent USING (entity) GROUP BY ALL", BEST.format(k=10)))
def _(s, d):
    return _ranked(R.top_k_rank(*_seeded(s, d)))


A04 = _rank_sql("SELECT sample_id, doc_id, sum(idf) AS score FROM best JOIN idf USING (entity) JOIN v_doc_ent USING (entity) GROUP BY ALL", BEST.format(k=20))


@query("a04_topk_idf_rank", A04)
def a04(s, d):
    return _ranked(R.top_k_idf_rank(*_seeded(s, d)))


@query("f07_vocab_filter", f"WITH {V.SEEDS} SELECT sample_id, entity FROM v_seed WHERE entity IN (SELECT entity FROM v_doc_ent GROUP BY entity HAVING count(*) >= 20)")
def _(s, d):
    seeds, docs = _seeded(s, d)
    known = docs.groupBy("entity").agg(F.count("*").alias("n")).where("n >= 20")
    return seeds.join(known, "entity", "left_semi").select("sample_id", "entity")


@query("f03_anchors", f"SELECT DISTINCT p_partkey AS sample_id, {V.NORM.format('p_name')} AS anchor FROM part WHERE p_partkey % 5 <> 0 AND length({V.NORM.format('p_name')}) >= 4")
def _(s, d):
    head = F.when(F.col("p_partkey") % 5 == 0, "UNKNOWN part").otherwise(F.col("p_name"))
    return R.anchors(table(s, d, "part").select(F.col("p_partkey").alias("sample_id"), head.alias("head"), F.col("p_brand").alias("tail")))


@query("f04_match_cut", f"WITH {V.SCORE} SELECT id, score FROM v_score WHERE score <= 10.0")
def _(s, d):
    limits = F.coalesce(F.lit(10.0), F.lit(1.0))
    return V.scores(s, d).where(F.col("score") <= limits).select("id", "score")


@query("a05_scatter", f"WITH {V.SCORE}, g AS (SELECT id % 97 AS k, round(sum(score), 6) AS sum, round(avg(score), 6) AS mean, max(score) AS max, min(score) AS min, count(*) AS n FROM v_score GROUP BY 1) SELECT i AS k, coalesce(sum, 0) AS sum, coalesce(mean, 0) AS mean, coalesce(max, 0) AS max, coalesce(min, 0) AS min, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 99)) AS i) LEFT JOIN g ON i = k")
def _(s, d):
    ids = s.range(100).select(F.col("id").alias("k"))
    x = M.grouped_reduce(V.scores(s, d).withColumn("k", F.col("id") % 97), "k", ids)
    return x.select("k", F.round("sum", 6).alias("sum"), F.round("mean", 6).alias("mean"), "max", "min", "n")


@query("a06_group_softmax", f"WITH {V.SCORE}, m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sample)) AS e FROM v_score) SELECT sample, id, round(e / (sum(e) OVER (PARTITION BY sample) + 1e-12), 9) AS p FROM m")
def _(s, d):
    return softmax(V.scores(s, d), "score", ["sample"], "p").select("sample", "id", F.round("p", 9).alias("p"))


@query("a07_variadic_mean", f"WITH {V.SCORE} SELECT sample, round(sum(score), 5) AS total, round(avg(score), 9) AS mean FROM v_score GROUP BY sample")
def _(s, d):
    return V.scores(s, d).groupBy("sample").agg(F.round(F.sum("score"), 5).alias("total"), F.round(F.avg("score"), 9).alias("mean"))


@query("a08_masked_mean", f"WITH {V.SCORE} SELECT sample, round(avg(CASE WHEN target = 1 THEN score END), 9) AS masked_mean, round(avg(CASE WHEN id % 3 <> 0 THEN score END), 9) AS nan_mean FROM v_score GROUP BY sample")
def _(s, d):
    x = V.scores(s, d).withColumn("v", F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("score")))
    a = x.groupBy("sample").agg(F.avg(F.when(F.col("target") == 1, F.col("score"))).alias("masked_mean"))
    return a.join(M.masked_means(x, ["sample"], F.lit(True), "v").select("sample", "nan_mean"), "sample").select("sample", F.round("masked_mean", 9).alias("masked_mean"), F.round("nan_mean", 9).alias("nan_mean"))


@query("a09_logsumexp", f"WITH {V.SCORE}, m AS (SELECT *, max(score) OVER (PARTITION BY sample) AS m FROM v_score) SELECT sample, round(m + ln(sum(exp(score - m))), 9) AS logsumexp FROM m GROUP BY sample, m")
def _(s, d):
    return M.logsumexp(V.scores(s, d), ["sample"]).select("sample", F.round("logsumexp", 9).alias("logsumexp"))


HITS = V.MICRO_NORM + ", hits AS (SELECT ascii(tail) % 5 AS sample_id, triple_id, (length(head) % 7)::DOUBLE - 1 AS distance FROM v_micro_norm WHERE relation = 'p type' OR relation = 'c mktsegment')"


def _hits(s, d):
    m = V.micro_normalized(s, d)
    return m, m.where("relation = 'p type' or relation = 'c mktsegment'").select((F.ascii("tail") % 5).alias("sample_id"), "triple_id", ((F.length("head") % 7).cast("double") - 1).alias("distance"))


A10 = HITS + ", v_a10 AS (SELECT sample_id, doc_id, max(1 / (1 + greatest(0, distance))) AS score FROM hits JOIN v_micro_norm USING (triple_id) GROUP BY ALL)"


@query("a10_doc_micro_score", f"WITH {A10} SELECT sample_id, doc_id, round(score, 9) AS score FROM v_a10")
def _(s, d):
    m, hits = _hits(s, d)
    return R.micro_doc_scores(hits, m).withColumn("score", F.round("score", 9))


@query("r03_activated_entities", f"WITH {HITS}, a AS (SELECT triple_id, head AS entity FROM v_micro_norm UNION SELECT triple_id, tail FROM v_micro_norm) SELECT DISTINCT sample_id, entity FROM hits JOIN a USING (triple_id)")
def _(s, d):
    m, hits = _hits(s, d)
    return R.activated(hits, m.select("triple_id", F.explode(F.array("head", "tail")).alias("entity")))


A11 = V.MICRO_NORM + """, near AS (SELECT DISTINCT 1 AS sample_id, head AS anchor, head AS node, 0.0::DOUBLE AS distance FROM v_micro_norm WHERE relation = 'p type' UNION SELECT DISTINCT 1, head, tail, 0.5 FROM v_micro_norm WHERE relation = 'p type' UNION SELECT DISTINCT 1, tail, head, 1.5 FROM v_micro_norm WHERE relation = 'p type'),
inc AS (SELECT DISTINCT node, triple_id FROM (SELECT head AS node, triple_id FROM v_micro_norm UNION ALL SELECT tail, triple_id FROM v_micro_norm)), wt AS (SELECT *, len(list_filter(string_split(anchor, ' '), lambda x: x <> '')) AS n FROM near WHERE distance <= 1.0),
b AS (SELECT sample_id, doc_id, anchor, max(CASE WHEN n >= 3 THEN 1.0 WHEN n = 2 THEN 0.9 WHEN length(anchor) >= 10 THEN 0.6 ELSE 0.25 END::DOUBLE / (1 + distance)) AS s FROM wt JOIN inc USING (node) JOIN v_micro_norm USING (triple_id) GROUP BY ALL)"""


@query("a11_node_anchor_score", f"WITH {A11} SELECT sample_id, doc_id, round(sum(s), 6) AS score FROM b GROUP BY ALL")
def _(s, d):
    from tierlink.operators.build import incident_triples

    m = V.micro_normalized(s, d)
    t = m.where("relation = 'p type'")
    rows = [("head", "head", 0.0), ("head", "tail", 0.5), ("tail", "head", 1.5)]
    near = None
    for a, n, x in rows:
        part = t.select(F.lit(1).alias("sample_id"), F.col(a).alias("anchor"), F.col(n).alias("node"), F.lit(x).alias("distance")).distinct()
        near = part if near is None else near.unionByName(part)
    return R.anchor_doc_scores(near, incident_triples(m), m).withColumn("score", F.round("score", 6))


TWO = V.SCORE + ", a AS (SELECT sample AS sample_id, id % 50 AS doc_id, max(score) AS score FROM v_score WHERE id % 2 = 0 GROUP BY ALL), b AS (SELECT sample AS sample_id, id % 50 AS doc_id, max(score) AS score FROM v_score WHERE id % 3 = 0 GROUP BY ALL)"


def _two(s, d):
    v = V.scores(s, d)
    return [v.where(F.col("id") % k == 0).groupBy(F.col("sample").alias("sample_id"), (F.col("id") % 50).alias("doc_id")).agg(F.max("score").alias("score")) for k in (2, 3)]


@query("a12_merge_micro", f"WITH {TWO} SELECT sample_id, doc_id, round(greatest(max(score), 0), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT sample_id, doc_id, score * 0.5 FROM b) GROUP BY ALL")
def _(s, d):
    return R.merge_max(*_two(s, d), 0.5).withColumn("score", F.round("score", 9))


@query("a13_additive_merge", f"WITH {TWO} SELECT sample_id, doc_id, round(sum(score), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def _(s, d):
    return R.merge_sum(*_two(s, d)).withColumn("score", F.round("score", 9))


@query("w13_minmax", f"WITH {V.SCORE}, m AS (SELECT sample, id, CASE WHEN id % 2 = 0 THEN score ELSE 1.0 END AS x, id % 2 AS side FROM v_score), b AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM m WINDOW w AS (PARTITION BY sample, side)) SELECT sample, id, CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo) THEN 0 ELSE round((x - lo) / (hi - lo), 9) END AS scaled FROM b")
def _(s, d):
    x = V.scores(s, d).withColumn("side", F.col("id") % 2).withColumn("x", F.when(F.col("side") == 0, F.col("score")).otherwise(1.0))
    return x.select("sample", "id", F.round(min_max(F.col("x"), Window.partitionBy("sample", "side"), 0.0), 9).alias("scaled"))


@query("w14_micro_minmax", f"WITH {V.SCORE}, m AS (SELECT sample, id, CASE WHEN id % 2 = 0 THEN score ELSE 1.0 END AS x, id % 2 AS side FROM v_score WHERE target = 1), b AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM m WINDOW w AS (PARTITION BY sample, side)) SELECT sample, id, CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo) THEN 1 ELSE round((x - lo) / (hi - lo), 9) END AS scaled FROM b")
def _(s, d):
    x = V.scores(s, d).where("target = 1").withColumn("side", F.col("id") % 2).withColumn("x", F.when(F.col("side") == 0, F.col("score")).otherwise(1.0))
    return x.select("sample", "id", F.round(min_max(F.col("x"), Window.partitionBy("sample", "side"), 1.0), 9).alias("scaled"))


W15 = V.SCORE + ", r AS (SELECT sample, id, id % 3 = 0 AS is_image, row_number() OVER (PARTITION BY sample ORDER BY score DESC, id) AS rank FROM v_score), c AS (SELECT *, is_image AND sum(is_image::INT) OVER (PARTITION BY sample ORDER BY rank) > {cap} AS late FROM r), p AS (SELECT sample, id, is_image, rank, row_number() OVER (PARTITION BY sample ORDER BY late, rank) AS position FROM c)"


@query("w15_capped_select", f"WITH {W15.format(cap=1)} SELECT sample, id, is_image, rank, position FROM p WHERE position <= 6")
def _(s, d):
    r = M.raw_ranks(V.scores(s, d), ["sample"]).withColumn("is_image", F.col("id") % 3 == 0)
    return R.capped_select(r, ["sample"], 6, 1).select("sample", "id", "is_image", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"))


FUSE = V.SCORE + """, x AS (SELECT sample AS sample_id, id % 300 AS doc_id, max(CASE WHEN id % 2 = 0 THEN score ELSE 0 END) AS ts, max(CASE WHEN id % 2 = 1 THEN score ELSE 0 END) AS is_ FROM v_score GROUP BY ALL),
n AS (SELECT *, min(ts) OVER w AS tl, max(ts) OVER w AS th, min(is_) OVER w AS il, max(is_) OVER w AS ih FROM x WINDOW w AS (PARTITION BY sample_id)),
m AS (SELECT sample_id, doc_id, is_ AS s FROM x WHERE doc_id < 10), mm AS (SELECT sample_id, doc_id, CASE WHEN abs(h - l) <= 1e-8 + 1e-5 * abs(l) THEN 1.0 ELSE (s - l) / (h - l) END AS micro FROM (SELECT *, min(s) OVER (PARTITION BY sample_id) AS l, max(s) OVER (PARTITION BY sample_id) AS h FROM m)),
f AS (SELECT n.sample_id, n.doc_id, doc_id % 4 = 0 AS is_image, greatest(CASE WHEN abs(th - tl) <= 1e-8 + 1e-5 * abs(tl) THEN 0.0 ELSE (ts - tl) / (th - tl) END, coalesce(micro, CASE WHEN abs(ih - il) <= 1e-8 + 1e-5 * abs(il) THEN 0.0 ELSE (is_ - il) / (ih - il) END * 0.333333)) AS merged, greatest(ts, is_) AS score FROM n LEFT JOIN mm USING (sample_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY merged DESC, doc_id) AS rank FROM f), c AS (SELECT *, is_image AND sum(is_image::INT) OVER (PARTITION BY sample_id ORDER BY rank) > 2 AS late FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY late, rank) AS position FROM c)"""


@query("r01_dual_fusion", f"WITH {FUSE} SELECT sample_id, doc_id, round(merged, 9) AS merged, score, position FROM p WHERE position <= 8")
def _(s, d):
    v = V.scores(s, d)
    even, odd = F.when(F.col("id") % 2 == 0, F.col("score")).otherwise(0.0), F.when(F.col("id") % 2 == 1, F.col("score")).otherwise(0.0)
    x = v.groupBy(F.col("sample").alias("sample_id"), (F.col("id") % 300).alias("doc_id")).agg(F.max(even).alias("text_score"), F.max(odd).alias("image_score")).withColumn("is_image", F.col("doc_id") % 4 == 0)
    micro = x.where("doc_id < 10").select("sample_id", "doc_id", F.col("image_score").alias("score"))
    return R.fuse(x, 8, 2, micro).select("sample_id", "doc_id", F.round("merged", 9).alias("merged"), "score", F.col("position").cast("long").alias("position"))


@query("r02_image_test", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 = 0 ELSE false END AS is_image FROM labels")
def _(s, d):
    lab = table(s, d, "labels")
    ids = lab.where("doc_id % 6 = 0").select("doc_id", F.lit(True).alias("f"))
    return lab.join(ids, "doc_id", "left").select("doc_id", F.coalesce("f", F.lit(False)).alias("is_image"))


@query("r04_seed_expansion", f"WITH {V.SEEDS}, x AS (SELECT DISTINCT sample_id, (SELECT min(entity) FROM v_doc_ent) AS entity, 1.0::DOUBLE AS w FROM v_seed) SELECT sample_id, entity, max(w) AS w FROM (SELECT * FROM v_seed UNION ALL SELECT * FROM x) GROUP BY ALL")
def _(s, d):
    seeds, de = _seeded(s, d)
    extra = seeds.select("sample_id").distinct().crossJoin(F.broadcast(de.agg(F.min("entity").alias("entity"))))  # one row
    return R.expand_seeds(seeds, extra, de)


@query("u05_mask_union", f"WITH {V.SCORE} SELECT sample, id % 100 AS id, max(CASE WHEN score > 20 THEN 1.0 ELSE 0.0 END)::DOUBLE AS mask FROM v_score GROUP BY ALL")
def _(s, d):
    return V.scores(s, d).groupBy("sample", (F.col("id") % 100).alias("id")).agg(F.max(F.when(F.col("score") > 20, 1.0).otherwise(0.0)).alias("mask"))


MIX = V.SCORE + ", a AS (SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY score DESC, id) AS r FROM v_score), b AS (SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY abs(score - 15), id) AS r FROM v_score), u AS (SELECT sample, id, min(src * 1000 + r) AS k FROM (SELECT sample, id, 0 AS src, r FROM a WHERE r <= 20 UNION ALL SELECT sample, id, 1, r FROM b WHERE r <= 20) GROUP BY ALL)"


@query("u06_mixed_targets", f"WITH {MIX} SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY k) AS position FROM u")
def _(s, d):
    v = V.scores(s, d)
    return R.mixed_targets(v, v.withColumn("score", -F.abs(F.col("score") - 15))).withColumn("position", F.col("position").cast("long"))


@query("w01_rank", f"WITH {V.SCORE} SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY score DESC, id) AS rank FROM v_score")
def _(s, d):
    return M.raw_ranks(V.scores(s, d), ["sample"]).select("sample", "id", F.col("rank").cast("long").alias("rank"))


W02 = V.SCORE + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, id) AS rank FROM v_score), v_w02 AS (SELECT sample, id, rank, rank - row_number() OVER (PARTITION BY sample ORDER BY rank) + 1 AS filtered FROM r WHERE target = 1)"


def _w02(s, d):
    return M.filtered_ranks(V.scores(s, d), ["sample"], F.col("target") == 1)


@query("w02_filtered_rank", f"WITH {W02} SELECT sample, id, filtered FROM v_w02")
def _(s, d):
    return _w02(s, d).select("sample", "id", F.col("filtered").cast("long").alias("filtered"))


@query("w03_hard_rank", f"WITH {W02} SELECT sample, id, filtered FROM v_w02 WHERE id % 2 = 0")
def _(s, d):
    return _w02(s, d).where("id % 2 = 0").select("sample", "id", F.col("filtered").cast("long").alias("filtered"))


W04 = V.SCORE + ", v_w04 AS (SELECT sample, id, count(*) OVER (PARTITION BY sample) AS n, sum(1 - target) OVER (PARTITION BY sample ORDER BY score DESC RANGE UNBOUNDED PRECEDING)::BIGINT + 1 AS rank, target FROM v_score)"


@query("w04_pessimistic_rank", f"WITH {W04} SELECT sample, id, rank FROM v_w04 WHERE target = 1")
def _(s, d):
    return M.pessimistic_ranks(V.scores(s, d), ["sample"]).select("sample", "id", F.col("rank").cast("long").alias("rank"))


@query("w05_variadic_sort", f"WITH {V.SCORE} SELECT sample, id, score, row_number() OVER (PARTITION BY sample ORDER BY score, id) - 1 AS pos FROM v_score")
def _(s, d):
    order = Window.partitionBy("sample").orderBy("score", "id")
    return V.scores(s, d).select("sample", "id", "score", (F.row_number().over(order) - 1).cast("long").alias("pos"))


@query("w06_variadic_arange", f"WITH {V.SCORE} SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY id) - 1 AS pos FROM v_score")
def _(s, d):
    return V.scores(s, d).select("sample", "id", (F.row_number().over(Window.partitionBy("sample").orderBy("id")) - 1).cast("long").alias("pos"))


@query("w07_interval_union", """WITH e AS (SELECT event_type AS k, event_id * 3 AS start, event_id * 3 + 1 + event_id % 40 AS stop FROM events), m AS (SELECT *, max(stop) OVER (PARTITION BY k ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start) AS grp FROM m) SELECT k, min(start) AS start, max(stop) AS stop FROM g GROUP BY k, grp""")
def _(s, d):
    spans = table(s, d, "events").select(F.col("event_type").alias("k"), (F.col("event_id") * 3).alias("start"), (F.col("event_id") * 3 + 1 + F.col("event_id") % 40).alias("stop"))
    return M.interval_union(spans, ["k"])


@query("w08_variadic_concat", f"WITH {V.SCORE}, a AS (SELECT sample, id AS value, 0 AS s, id AS pos FROM v_score WHERE id % 2 = 0 UNION ALL SELECT sample, -id, 1, id FROM v_score WHERE id % 3 = 0) SELECT sample, value, row_number() OVER (PARTITION BY sample ORDER BY s, pos) - 1 AS pos FROM a")
def _(s, d):
    v = V.scores(s, d)
    a = v.where("id % 2 = 0").select("sample", F.col("id").alias("value"), F.col("id").alias("pos"))
    b = v.where("id % 3 = 0").select("sample", (-F.col("id")).alias("value"), F.col("id").alias("pos"))
    return M.variadic_concat(a, b, ["sample"]).withColumn("pos", F.col("pos").cast("long"))


@query("w09_topk_group", f"WITH {V.SCORE} SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY score DESC, id) AS rank FROM v_score QUALIFY rank <= 10")
def _(s, d):
    return R.top_k(V.scores(s, d), ["sample"], 10).select("sample", "id", F.col("rank").cast("long").alias("rank"))


@query("w12_k_smallest", f"WITH {V.SCORE}, x AS (SELECT sample, floor(score) AS score, id::VARCHAR AS payload FROM v_score), k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score, payload DESC) <= 5) SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score, payload) AS position FROM k")
def _(s, d):
    x = V.scores(s, d).select("sample", F.floor("score").cast("double").alias("score"), F.col("id").cast("string").alias("payload"))
    return R.k_smallest(x, ["sample"], 5, "score", "payload").withColumn("position", F.col("position").cast("long"))


@query("w16_ranked_limit", f"WITH {V.SCORE} SELECT sample, id, score FROM v_score ORDER BY score DESC, id LIMIT 50")
def _(s, d):
    return V.scores(s, d).select("sample", "id", "score").orderBy(F.col("score").desc(), "id").limit(50)


@query("w18_ordered_dedup", "SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS items FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.array("p_brand", "p_type", "p_brand", "p_name", "p_type")), "|").alias("items"))


@query("w19_anchor_pick", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS items FROM part")
def _(s, d):
    captions, others = F.array("p_name"), F.array("p_name", "p_brand", "p_type", F.lit("extra"))
    return table(s, d, "part").select("p_partkey", F.array_join(F.concat(captions, F.slice(F.array_except(others, captions), 1, 2)), "|").alias("items"))


@query("w21_hash_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 100")
def _(s, d):
    return table(s, d, "documents").select("doc_id").orderBy(F.md5(F.concat_ws("|", "doc_id", F.lit("42"))), "doc_id").limit(100)


@query("w23_top1_doc", f"WITH {TWO} SELECT a.sample_id, coalesce(b.doc_id, a.doc_id) AS doc_id FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, doc_id) = 1) a LEFT JOIN (SELECT * FROM b WHERE sample_id <> 'click' QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, doc_id) = 1) b USING (sample_id)")
def _(s, d):
    macro, merged = (R.top_k(x, ["sample_id"], 1, "score", "doc_id") for x in _two(s, d))
    m = merged.where("sample_id <> 'click'").select("sample_id", F.col("doc_id").alias("m"))
    return macro.join(m, "sample_id", "left").select("sample_id", F.coalesce("m", "doc_id").alias("doc_id"))


@query("a19_link_metrics", f"WITH {W04}, r AS (SELECT rank FROM v_w04 WHERE target = 1) SELECT round(avg(rank), 6) AS mr, round(avg(1.0::DOUBLE / rank), 9) AS mrr, round(avg((rank <= 1)::INT), 9) AS hits_1, round(avg((rank <= 3)::INT), 9) AS hits_3, round(avg((rank <= 10)::INT), 9) AS hits_10 FROM r")
def _(s, d):
    m = M.link_metrics(M.pessimistic_ranks(V.scores(s, d), ["sample"]))
    return m.select(F.round("mr", 6).alias("mr"), *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@query("a19_sampled_hits", f"WITH {W04}, r AS (SELECT (rank - 1.0::DOUBLE) / (n - 1) AS p FROM v_w04 WHERE target = 1) SELECT round(avg(pow(1 - p, 50) + 50 * p * pow(1 - p, 49) + 1225 * pow(p, 2) * pow(1 - p, 48)), 9) AS hits_3_50 FROM r")
def _(s, d):
    v = V.scores(s, d)
    r = M.pessimistic_ranks(v, ["sample"]).join(v.groupBy("sample").agg(F.count("*").alias("n")), "sample")
    return r.agg(F.round(F.avg(M.sampled_hits(F.col("rank"), F.col("n"), 50, 3)), 9).alias("hits_3_50"))


@query("a20_qa_metrics", f"WITH {W02}, q AS (SELECT sample, avg(1.0::DOUBLE / filtered) AS mrr, avg((rank <= 1)::INT) AS recall_1, avg((rank <= 2)::INT) AS recall_2, avg((rank <= 5)::INT) AS recall_5, avg((filtered <= 1)::INT) AS hits_1, avg((filtered <= 2)::INT) AS hits_2, avg((filtered <= 5)::INT) AS hits_5 FROM v_w02 GROUP BY sample) SELECT round(avg(mrr), 9) AS mrr, round(avg(recall_1), 9) AS recall_1, round(avg(recall_2), 9) AS recall_2, round(avg(recall_5), 9) AS recall_5, round(avg(hits_1), 9) AS hits_1, round(avg(hits_2), 9) AS hits_2, round(avg(hits_5), 9) AS hits_5 FROM q")
def _(s, d):
    m = M.qa_metrics(_w02(s, d), ["sample"])
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("a21_typed_metrics", f"WITH {W02} SELECT coalesce(sample, 'all') AS kind, round(avg(1.0::DOUBLE / filtered), 9) AS mrr FROM v_w02 GROUP BY ROLLUP (sample)")
def _(s, d):
    return _w02(s, d).rollup("sample").agg(F.round(F.avg(1 / F.col("filtered")), 9).alias("mrr")).select(F.coalesce("sample", F.lit("all")).alias("kind"), "mrr")


@query("a22_spearman", f"WITH {V.SCORE}, x AS (SELECT sample, score, floor(score / 10) AS b FROM v_score), r AS (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY score) + (count(*) OVER (PARTITION BY sample, score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY sample ORDER BY b) + (count(*) OVER (PARTITION BY sample, b) - 1) / 2.0::DOUBLE AS rb FROM x) SELECT sample, round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb) + 1e-10), 6) AS spearman FROM r GROUP BY sample")
def _(s, d):
    x = V.scores(s, d).select("sample", "score", F.floor(F.col("score") / 10).alias("b"))
    return M.spearman(x, ["sample"], "score", "b").withColumn("spearman", F.round("spearman", 6))


@query("a23_auroc", f"WITH {V.SCORE}, p AS (SELECT *, sum(target) OVER (PARTITION BY sample ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS c FROM v_score) SELECT sample, round(sum(c * (1 - target))::DOUBLE / (sum(target)::DOUBLE * sum(1 - target) + 1e-10), 9) AS auroc FROM p GROUP BY sample")
def _(s, d):
    return M.auroc(V.scores(s, d), ["sample"]).withColumn("auroc", F.round("auroc", 9))


RECALL = BEST.format(k=20) + ", " + V.GOLD + """, r AS (SELECT sample_id, doc_id, round(sum(idf), 6) AS score FROM best JOIN idf USING (entity) JOIN v_doc_ent USING (entity) GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10),
g AS (SELECT DISTINCT sample_id, doc_id FROM v_gold), n AS (SELECT sample_id, count(*) AS n FROM g GROUP BY 1), h AS (SELECT sample_id, sum((rank <= 1)::INT) AS h1, sum((rank <= 2)::INT) AS h2, sum((rank <= 5)::INT) AS h5, sum((rank <= 10)::INT) AS h10 FROM q JOIN g USING (sample_id, doc_id) GROUP BY 1)"""


def _recall(s, d, empty):
    ranked = _ranked(R.top_k_idf_rank(*_seeded(s, d)), 10)
    m = M.recall_at(ranked, V.gold(s, d), empty=empty)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


for _name, _join, _empty in (("a24_recall_at_k", "JOIN", "skip"), ("a25_recall_at_k_ordered", "LEFT JOIN", "zero")):
    _cols = ", ".join(f"round(avg(coalesce(h{k}::DOUBLE / n, 0)), 9) AS recall_{k}" for k in (1, 2, 5, 10))
    query(_name, f"WITH {RECALL} SELECT {_cols} FROM (SELECT DISTINCT sample_id FROM q) s {_join} n USING (sample_id) LEFT JOIN h USING (sample_id)")(lambda s, d, e=_empty: _recall(s, d, e))


@query("a27_rouge_l")
def _(s, d):
    p = V.predictions(s, d)
    return p.select("id", F.round(M.rouge_l(T.tokens(F.lower("response")), T.tokens(F.lower("answer"))), 9).alias("rouge_l"))


JUDGE = V.BUCKETS + ", j AS (SELECT correct AS direct, 1 - other AS rag, CASE WHEN id % 3 = 0 THEN correct ELSE 1 - other END AS final, CASE WHEN id % 2 = 0 THEN 'judge_a' ELSE 'auto' END AS source FROM v_buckets)"


@query("a17_bucket_accuracy", f"WITH {V.BUCKETS} SELECT subject, grade, count(*) AS n, sum(correct)::BIGINT AS n_correct, round(avg(correct), 9) AS accuracy FROM v_buckets GROUP BY GROUPING SETS ((), (subject), (grade))")
def _(s, d):
    m = M.bucket_accuracy(V.buckets(s, d), ["subject", "grade"])
    return m.select("subject", "grade", "n", "n_correct", F.round("accuracy", 9).alias("accuracy"))


@query("a18_judge_summary", f"WITH {JUDGE} SELECT count(*) AS n, round(avg(direct), 9) AS direct, round(avg(rag), 9) AS rag, round(avg(greatest(direct, rag)), 9) AS oracle_or, round(avg(final), 9) AS final, sum(starts_with(source, 'judge')::INT)::BIGINT AS n_judged FROM j")
def _(s, d):
    b = V.buckets(s, d).select(F.col("correct").alias("direct"), (1 - F.col("other")).alias("rag"), F.when(F.col("id") % 3 == 0, F.col("correct")).otherwise(1 - F.col("other")).alias("final"), F.when(F.col("id") % 2 == 0, "judge_a").otherwise("auto").alias("source"))
    m = M.judge_summary(b)
    return m.select("n", *[F.round(c, 9).alias(c) for c in ("direct", "rag", "oracle_or", "final")], "n_judged")


LOGIT = V.SCORE + ", l AS (SELECT sample, id, target, (score - 20) / 10 AS score FROM v_score), z AS (SELECT *, CASE WHEN target = 1 THEN score ELSE -score END AS sg, count(*) OVER (PARTITION BY sample, target) AS n, max(score / {t}) OVER (PARTITION BY sample, target) AS mx FROM l), w AS (SELECT *, ln(1 + exp(-abs(sg))) + greatest(-sg, 0) AS loss, exp(score / {t} - mx) AS e FROM z)"


def _logits(s, d):
    return V.scores(s, d).withColumn("score", (F.col("score") - 20) / 10)


for _name, _t, _w in (("a28_adv_bce", 1.0, True), ("a29_bce_loss", 0.2, True), ("a29_bce_uniform", 1.0, False)):
    _weight = "CASE WHEN target = 1 THEN 1.0::DOUBLE / n ELSE e / (sum(e) OVER (PARTITION BY sample, target) + 1e-12) END" if _w else "1.0::DOUBLE / n"
    query(_name, f"WITH {LOGIT.format(t=_t)}, v AS (SELECT *, {_weight} AS wt FROM w), r AS (SELECT sample, sum(loss * wt) / sum(wt) AS loss FROM v GROUP BY sample) SELECT round(avg(loss), 9) AS loss FROM r")(
        lambda s, d, t=_t if _w else 0.0: M.bce_loss(_logits(s, d), ["sample"], t).select(F.round("loss", 9).alias("loss"))
    )


@query("a30_listce_loss", f"WITH {V.SCORE}, l AS (SELECT sample, target, 1 / (1 + exp(-(score - 20) / 10)) AS s FROM v_score), t AS (SELECT *, sum(s) OVER (PARTITION BY sample) AS t FROM l), r AS (SELECT sample, avg(-ln(s / (t + 1e-5) + 1e-5)) AS loss FROM t WHERE target = 1 GROUP BY sample) SELECT round(avg(loss), 9) AS loss FROM r")
def _(s, d):
    return M.list_ce_loss(_logits(s, d), ["sample"]).select(F.round("loss", 9).alias("loss"))


@query("a31_soft_size", f"WITH {V.SCORE}, l AS (SELECT sample, 1 / (1 + exp(-(score - 20) / 10)) AS p FROM v_score) SELECT sample, round(sum(CASE WHEN p > 0.5 THEN p ELSE 0 END), 6) AS size FROM l GROUP BY sample")
def _(s, d):
    return M.soft_size(_logits(s, d), ["sample"]).withColumn("size", F.round("size", 6))


@query("j14_align_ids", "SELECT rid, CASE WHEN try_cast(rid AS BIGINT) < (SELECT count(*) FROM benchmark) THEN 'item-' || rid WHEN rid LIKE 'item-%' THEN rid END AS id FROM (SELECT CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR WHEN item_id % 3 = 0 THEN 'item-' || item_id ELSE (item_id + 100000)::VARCHAR END AS rid FROM benchmark)")
def _(s, d):
    b = table(s, d, "benchmark")
    name = F.concat(F.lit("item-"), F.col("item_id").cast("string"))
    rid = F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string")).when(F.col("item_id") % 3 == 0, name).otherwise((F.col("item_id") + 100000).cast("string"))
    return R.align_ids(b.select(F.col("item_id").alias("pos"), name.alias("id")), b.select(rid.alias("rid")))


@query("j15_merge_rankings", "SELECT item_id AS id, item_id % 7 AS macro, CASE WHEN item_id % 2 = 0 THEN item_id % 5 END AS micro FROM benchmark")
def _(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("id"))
    micro = b.select("id", (F.col("id") % 5).alias("m"))
    return b.select("id", (F.col("id") % 7).alias("macro")).join(micro, "id", "left").select("id", "macro", F.when(F.col("id") % 2 == 0, F.col("m")).alias("micro"))


@query("j16_direct_vs_rag", f"WITH {V.BUCKETS} SELECT id, correct AS direct, 1 - other AS rag FROM v_buckets WHERE id % 3 <> 0")
def _(s, d):
    b = V.buckets(s, d)
    return b.select("id", F.col("correct").alias("direct")).join(b.where("id % 3 <> 0").select("id", (1 - F.col("other")).alias("rag")), "id")


@query("j18_budget_lookup", "SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 2 WHEN item_id % 3 = 1 THEN 5 ELSE 6 END AS budget FROM benchmark")
def _(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    by_q = b.where("id % 3 <> 2").select(F.concat(F.lit(" "), "question").alias("question"), F.lit(5).alias("budget"))
    return R.budget_lookup(b, b.where("id % 3 = 0").select("id", F.lit(2).alias("budget")), by_q, 6)


@query("j19_resolve_title", "SELECT 'SRC' || (doc_id % 20) AS name, doc_id::VARCHAR AS doc_id FROM documents WHERE source = 'src' || (doc_id % 20) UNION SELECT name, doc_id FROM (SELECT 'SRC' || i AS name FROM (SELECT unnest(generate_series(0, 19)) AS i)) JOIN (SELECT lower(source) AS t, doc_id::VARCHAR AS doc_id FROM documents) ON lower(name) = t UNION SELECT doc_id::VARCHAR, doc_id::VARCHAR FROM documents WHERE doc_id < 5")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"))
    names = s.range(20).select(F.concat(F.lit("SRC"), F.col("id").cast("string")).alias("name")).unionByName(s.range(5).select(F.col("id").cast("string").alias("name")))
    return R.resolve_titles(names, docs, docs)


@query("k04_resume_anti_join", "SELECT event_id FROM events WHERE (user_id, value) NOT IN (SELECT (user_id, value) FROM events WHERE event_type = 'purchase')")
def _(s, d):
    e = table(s, d, "events")
    return R.resume(e, e.where("event_type = 'purchase'"), ["user_id", "value"]).select("event_id")
