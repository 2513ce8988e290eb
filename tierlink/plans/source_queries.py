"""Catalogue of readers, sinks, caches and data preparation: tables are written out in the shared folder and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.plans import rank_queries
from tierlink.plans import views as V
from tierlink.session import shared_dir, table
from tierlink.sources import prepare, readers, sinks
from tierlink.streaming import incremental

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/files-{uuid.uuid4().hex}"


def json_object(s: SparkSession, pairs: DataFrame, value: str = "value") -> str:
    """Path of one JSON object of the (few) pairs key -> value; values are JSON texts."""
    path = folder(s)
    body = F.array_join(F.sort_array(F.collect_list(F.concat(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(":"), F.col(value)))), ",")
    pairs.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return path


def quoted(c) -> F.Column:
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - 2)


def touch(s: SparkSession, path: str) -> None:
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.writeBytes("x")  # listings skip empty files
    out.close()


# -- readers ------------------------------------------------------------------------------------------
@query("s01_corpus", "SELECT 'n' || n_nationkey AS doc_id, n_name || chr(10) || 'x' AS text FROM nation")
def _(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), quoted(F.concat("n_name", F.lit("\nx"))).alias("value"))
    return readers.corpus(s, json_object(s, n))


@query("s03_multimodal", "SELECT 'r' || r_regionkey AS doc_id, r_name AS title, 1 AS n_images FROM region UNION ALL SELECT 'k' || r_regionkey, 'k' || r_regionkey, 0 FROM region")
def _(s, d):
    r = table(s, d, "region")
    item = F.to_json(F.struct(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.col("r_name").alias("title"), F.array(F.struct(F.lit("i").alias("image_id"), F.lit("c").alias("caption"))).alias("images")))
    listed, keyed = folder(s), json_object(s, r.select(F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("key"), F.lit('{"text":"t"}').alias("value")))
    r.select(item.alias("j")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit(", 7]")).alias("value")).coalesce(1).write.text(listed)
    both = readers.multimodal(s, listed).unionByName(readers.multimodal(s, keyed))
    return both.select("doc_id", "title", F.coalesce(F.array_size("images"), F.lit(0)).alias("n_images"))


SUPPLIERS = "s_suppkey long, s_name string"


def _suppliers(s, d, junk: bool) -> str:
    path = folder(s)
    sup = table(s, d, "supplier").select("s_suppkey", "s_name")
    sup.write.json(path)
    if junk:
        s.range(3).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return path


@query("s05_json_lines_strict", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    return readers.json_lines(s, _suppliers(s, d, False), SUPPLIERS)


@query("s06_json_lines_tolerant", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    return readers.json_lines(s, _suppliers(s, d, True), SUPPLIERS, strict=False)


@query("s13_media_metadata", "SELECT lower(lang) AS title, max(doc_id) AS doc_id FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def _(s, d):
    docs = table(s, d, "documents").where("lang is not null").select("doc_id", F.upper("lang").alias("title"), F.col("doc_id").alias("pos"))
    return readers.last_titles(docs)


@query("s14_streamed_lines", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    path, out, marks = _suppliers(s, d, True), folder(s), folder(s)
    stream = readers.stream_json_lines(s, path, SUPPLIERS)
    incremental.append_new(stream, out, ["s_suppkey"], marks, lambda x: x)
    return s.read.parquet(out)


@query("s17_split_router", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'corpus' END AS side FROM orders WHERE o_orderkey % 3 <> 1")
def _(s, d):
    k = F.col("o_orderkey") % 3
    corpus, test = readers.split_router(table(s, d, "orders").select("o_orderkey", F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split")))
    return corpus.select("o_orderkey", F.lit("corpus").alias("side")).unionByName(test.select("o_orderkey", F.lit("test").alias("side")))


@query("m22_split", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def _(s, d):
    return prepare.split_of(table(s, d, "orders"), "O", "o_orderstatus").select("o_orderkey")


IMAGES = "f AS (SELECT r_name AS folder, unnest([n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.png' ELSE '.jpg' END, 'image.png']) AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("s18_question_images", f"WITH {IMAGES} SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY name <> 'image.png', name) AS rank FROM (SELECT DISTINCT * FROM f)")
def _(s, d):
    """A folder for each region with an image for each nation; the files (a fixed table's rows) are made by the driver."""
    root = folder(s)
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey")
    for r in n.collect():
        for name in (f"{r['n_name']}.{'jpg' if r['n_nationkey'] % 2 else 'png'}", f"{r['n_name']}.txt", "image.png"):
            touch(s, f"{root}/{r['r_name']}/{name}")
    return readers.question_images(s, root).select(F.regexp_replace("folder", "%20", " ").alias("folder"), "name", "rank")


@query("s20_stored_or_built", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    path = folder(s)
    build = lambda: table(s, d, "nation").select("n_nationkey", "n_name")
    readers.table_or_build(s, path, build)
    return readers.table_or_build(s, path, lambda: build().where("false"))  # the stored table is read, not built again


@query("m08_absent_table", "SELECT n_name AS entity FROM nation")
def _(s, d):
    absent = prepare.table_or_empty(s, folder(s), "entity string")
    return table(s, d, "nation").select(F.col("n_name").alias("entity")).unionByName(absent)


@query("m04_properties", "SELECT * FROM (VALUES ('entities', (SELECT count(*) FROM nation)), ('documents', (SELECT count(*) FROM documents)), ('doc_entity', 0), ('image_docs', 0), ('image_entity', 0), ('relations', 0), ('test', 0), ('train', 0)) t(name, n)")
def _(s, d):
    root = folder(s)
    table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id")).write.parquet(f"{root}/entities")
    table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content")).write.parquet(f"{root}/documents")
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in prepare.properties(s, root).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("m17_keyed_items", "SELECT 'n' || n_nationkey AS key, n_name AS name, n_nationkey AS size FROM nation WHERE n_nationkey % 3 <> 0")
def _(s, d):
    k = F.col("n_nationkey")
    value = F.when(k % 3 == 0, '"a text"').otherwise(F.to_json(F.struct(F.col("n_name").alias("name"), k.alias("size"))))
    path = json_object(s, table(s, d, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("key"), value.alias("value")).unionByName(s.range(1).select(F.lit(" ").alias("key"), F.lit("{}").alias("value"))))
    return prepare.keyed_items(s, path, "name string, size int")


@query("m17_keyed_texts", "SELECT 'n' || n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey % 4 <> 0")
def _(s, d):
    k = F.col("n_nationkey")
    value = F.when(k % 4 == 0, quoted(F.lit("  "))).otherwise(quoted(F.concat("n_name", F.lit(" "))))
    return prepare.keyed_texts(s, json_object(s, table(s, d, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("key"), value.alias("value"))))


@query("m24_first_path", "SELECT n_nationkey FROM nation")
def _(s, d):
    there = folder(s)
    table(s, d, "nation").select("n_nationkey").write.parquet(there)
    return s.read.parquet(prepare.first_path(s, [None, folder(s), there]))


@query("m05_branch_folder", "SELECT r_regionkey FROM region")
def _(s, d):
    root = folder(s)
    path = f"{root}/{sinks.fingerprint({'branch': 'text', 'k': 1})}"
    table(s, d, "region").select("r_regionkey").write.parquet(path)
    return s.read.parquet(f"{root}/{sinks.fingerprint({'k': 1, 'branch': 'text'})}")  # the order of settings doesn't matter


# -- sinks and caches -------------------------------------------------------------------------------------
@query("k01_write_if_absent", "SELECT n_nationkey FROM nation")
def _(s, d):
    path, n = folder(s), table(s, d, "nation").select("n_nationkey")
    sinks.write_if_absent(n, path)
    sinks.write_if_absent(n.where("false"), path)
    return s.read.parquet(path)


@query("k10_force_rebuild", "SELECT n_nationkey FROM nation WHERE n_nationkey > 5")
def _(s, d):
    path, n = folder(s), table(s, d, "nation").select("n_nationkey")
    sinks.write_if_absent(n, path)
    sinks.write_if_absent(n.where("n_nationkey > 5"), path, force=True)
    return s.read.parquet(path)


ARTIFACTS = {"edges": ("nation", "n_name"), "micro": ("documents", "text"), "align": ("supplier", "s_name"), "doc_entity": ("benchmark", "text"), "image_entity": ("part", "p_name"), "stats": ("region", "r_name")}


@query("k02_index_artifacts", " UNION ALL ".join(f"SELECT '{a}' AS name, coalesce({c}, '') AS value FROM {t}" for a, (t, c) in ARTIFACTS.items()))
def _(s, d):
    """Six artifacts of different rows, written together and read back each by its name."""
    from tierlink.plans.pipelines import Index

    root = folder(s)
    Index(**{a: table(s, d, t).select(F.coalesce(c, F.lit("")).alias("value")) for a, (t, c) in ARTIFACTS.items()}).write(root)
    back = [s.read.parquet(f"{root}/{a}").select(F.lit(a).alias("name"), "value") for a in ARTIFACTS]
    return reduce(DataFrame.unionByName, back)


@query("k03_json_sink", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    path = folder(s)
    sinks.write_json(table(s, d, "nation").select("n_nationkey", "n_name"), path)
    return readers.json_lines(s, path, "n_nationkey int, n_name string")


CACHED = {"k05_document_cache": ["doc_id"], "k06_description_cache": ["cache_key"], "k07_recognition_cache": ["id"], "k08_budget_cache": ["question_index", "qid"]}


def _cached(keys):
    """A cache filled with half of the rows, then with all: each row is processed once, gone rows don't show."""

    def run(s, d):
        e = table(s, d, "events")
        k = F.col("event_id")
        rows = e.select(k.alias("doc_id"), sinks.content_key("event_type", "props").alias("cache_key"), k.alias("id"), (k % 10).alias("question_index"), k.alias("qid"), "event_type", "value")
        path = folder(s)
        once = lambda x: x.select(*keys, F.current_timestamp().alias("done"))
        sinks.append_missing(rows.where("event_type = 'click'"), path, keys, once)
        got = sinks.append_missing(rows.where("event_type in ('click', 'view')"), path, keys, once)
        return got.groupBy(*keys).agg(F.count("*").alias("n"))

    return run


for _name, _keys in CACHED.items():
    _cols = {"doc_id": "event_id AS doc_id", "cache_key": "event_type || '|' || md5('{\"props\":' || to_json(props) || '}') AS cache_key", "id": "event_id AS id", "question_index": "event_id % 10 AS question_index", "qid": "event_id AS qid"}
    query(_name, f"SELECT DISTINCT {', '.join(_cols[c] for c in _keys)}, 1 AS n FROM events WHERE event_type IN ('click', 'view')")(_cached(_keys))


@query("k09_judge_resume", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) WHERE n >= 20 AND n < 70 AND event_id % 7 <> 0")
def _(s, d):
    e = table(s, d, "events").select("event_id")
    return sinks.judge_slice(e, e.where("event_id % 7 = 0"), "event_id", 20, 50)


@query("k11_predictions", "SELECT doc_id AS id, quality AS answer, 0.5::DOUBLE AS em FROM labels")
def _(s, d):
    path = folder(s)
    sinks.write_predictions(table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("answer")), s.range(1).select(F.lit(0.5).alias("em")), path)
    rows = readers.json_lines(s, f"{path}/prediction", "id long, answer long")
    return rows.crossJoin(F.broadcast(readers.json_lines(s, f"{path}/metrics", "em double")))


@query("k12_ranking_export", f"WITH {V.SCORE}, r AS (SELECT sample AS sample_id, id, score, row_number() OVER (PARTITION BY sample ORDER BY score DESC, id) AS rank FROM v_score QUALIFY rank <= 3) SELECT sample_id, string_agg(id || ':' || coalesce(text, ''), ',' ORDER BY rank) AS ranking FROM r LEFT JOIN documents ON doc_id = id GROUP BY 1")
def _(s, d):
    x = V.scores(s, d).select(F.col("sample").alias("sample_id"), F.col("id").alias("doc_id"), "score")
    out = sinks.export_ranking(x, table(s, d, "documents").select("doc_id", F.col("text").alias("content")), 3)
    return out.select("sample_id", F.array_join(F.transform("ranking", lambda r: F.concat(r["doc_id"].cast("string"), F.lit(":"), F.coalesce(r["content"], F.lit("")))), ",").alias("ranking"))


@query("k13_metrics_csv", f"WITH {V.SCORE} SELECT sample AS metric, round(avg(score), 4) AS value FROM v_score GROUP BY 1 UNION ALL SELECT 'all', round(avg(score), 4) FROM v_score")
def _(s, d):
    path, v = folder(s), V.scores(s, d)
    sinks.write_metrics_csv(v.groupBy(F.col("sample").alias("metric")).agg(F.avg("score").alias("value")), path)
    sinks.write_metrics_csv(v.agg(F.avg("score").alias("value")).select(F.lit("all").alias("metric"), "value"), path)
    return s.read.csv(path, header=True, schema="metric string, value double")


@query("m25_printed_metrics", f"WITH {V.SCORE} SELECT sample || ': ' || printf('%.4f', avg(score)) AS line FROM v_score GROUP BY sample")
def _(s, d):
    return sinks.metric_lines(V.scores(s, d).groupBy(F.col("sample").alias("metric")).agg(F.avg("score").alias("value")))


@query("k14_failures", "SELECT event_id, 'no click' AS error FROM events WHERE event_type <> 'click'")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_type") != "click", "no click").alias("error"))
    return sinks.failures(e)


@query("k16_index_summary", "SELECT count(*) AS n, 64 AS dim FROM embeddings")
def _(s, d):
    return sinks.index_summary(table(s, d, "embeddings").select(F.col("embedding").alias("v")))


@query("k17_table_matrix", "SELECT p_partkey, 'brand|type||' AS head, p_brand || '|' || p_type || '|' || p_name || '|x' AS body FROM part")
def _(s, d):
    m = sinks.table_matrix(F.array(F.lit("brand"), F.lit("type")), F.array(F.array(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lit("x"))))
    return table(s, d, "part").select("p_partkey", F.array_join(m[0], "|").alias("head"), F.array_join(m[1], "|").alias("body"))


# -- preparation ---------------------------------------------------------------------------------------------
def _mmqa(s, d):
    p = table(s, d, "part")
    key = F.concat(F.lit("d"), F.col("p_partkey").cast("string"))
    texts = p.where("p_partkey % 2 = 0").select(key.alias("doc_id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("text"))
    images = p.where("p_partkey % 3 = 0").select(key.alias("doc_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("image_id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"))
    tables = p.where("p_partkey % 5 = 0").select(key.alias("doc_id"), F.col("p_name").alias("title"), F.lit("t").alias("name"), F.lit("t1").alias("table_id"), F.array(F.lit("brand")).alias("headers"), F.array(F.array("p_brand", "p_type")).alias("rows"))
    return texts, images, tables


@query("s15_corpus", "SELECT 'd' || p_partkey AS doc_id, CASE WHEN p_partkey % 5 = 0 THEN p_name || chr(10) || 'Table: t' || chr(10) || 'Columns: brand' || chr(10) || 'Row: ' || p_brand || ' | ' || p_type WHEN p_partkey % 4 = 0 THEN p_name || chr(10) || p_brand ELSE 'd' || p_partkey || chr(10) || p_brand END AS text FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0")
def _(s, d):
    texts, _, tables = _mmqa(s, d)
    return prepare.text_and_table_corpus(texts, tables)


@query("s15_multimodal", "SELECT 'd' || p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN p_name ELSE 'd' || p_partkey END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS text, CASE WHEN p_partkey % 3 = 0 THEN 'd' || p_partkey || ',/pics/' || p_partkey || '.png,' || p_name ELSE '' END AS image, CASE WHEN p_partkey % 5 = 0 THEN 't1:[{\"brand\":\"' || p_brand || '\",\"col_1\":\"' || p_type || '\"}]' ELSE '' END AS tab FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def _(s, d):
    m = prepare.multimodal_docs(*_mmqa(s, d), "/pics")
    i, t = F.get("images", F.lit(0)), F.get("tables", F.lit(0))
    return m.select("doc_id", "title", "text", F.concat_ws(",", i["image_id"], i["path_or_url"], i["caption"]).alias("image"), F.coalesce(F.concat(t["table_id"], F.lit(":"), t["rows"]), F.lit("")).alias("tab"))


@query("s15_test", "SELECT p_partkey AS id, p_name AS question, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS answer, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS aliases, p_brand || ',' || p_type AS facts FROM part")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("answer"), F.array("p_type").alias("answers"), F.array(F.col("p_brand"), F.lit(""), F.col("p_type"), F.col("p_brand")).alias("context"))
    t = prepare.context_test(p)
    return t.select("id", "question", "answer", F.array_join("answer_aliases", ",").alias("aliases"), F.array_join("supporting_facts", ",").alias("facts"))


def _webqa(s, d):
    k = F.col("p_partkey")
    text = lambda key, fact: F.struct(key.cast("string").alias("snippet_id"), F.col("p_name").alias("title"), fact.alias("fact"), F.lit("extra").alias("url"))
    image = lambda key: F.struct(key.cast("long").alias("image_id"), F.col("p_name").alias("title"), F.col("p_type").alias("caption"))
    lists = {"text_pos": F.array(text(k, F.col("p_brand"))), "text_neg": F.array(text(k - k % 4, F.col("p_type")), text(F.lit(""), F.col("p_type"))), "image_pos": F.array(image(k - k % 3), image(F.when(k % 2 == 0, k))), "image_neg": F.array(image(k + 1))}
    return table(s, d, "part").select(k.alias("seq"), k.alias("id"), F.concat(F.lit('"'), "p_name", F.lit('"')).alias("question"), F.array(F.concat(F.lit('"'), "p_brand", F.lit('"')), "p_type").alias("answer"), *[v.alias(n) for n, v in lists.items()])


@query("s16_webqa_texts", "WITH f AS (SELECT p_partkey AS seq, 0 AS l, p_partkey AS k, p_name, p_brand AS fact FROM part UNION ALL SELECT p_partkey, 1, p_partkey - p_partkey % 4, p_name, p_type FROM part) SELECT k::VARCHAR AS snippet_id, arg_min(p_name, seq * 10 + l) AS title, arg_min(fact, seq * 10 + l) AS fact FROM f GROUP BY k")
def _(s, d):
    return prepare.webqa_corpora(_webqa(s, d))[0]


@query("m18_image_facts", "WITH f AS (SELECT p_partkey AS seq, 0 AS l, p_partkey - p_partkey % 3 AS k, p_name, p_type FROM part UNION ALL SELECT p_partkey, 1, p_partkey, p_name, p_type FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 2, p_partkey + 1, p_name, p_type FROM part) SELECT k::VARCHAR AS image_id, arg_min(p_name, seq * 10 + l) AS title, arg_min(p_type, seq * 10 + l) AS caption FROM f GROUP BY k")
def _(s, d):
    return prepare.webqa_corpora(_webqa(s, d))[1]


@query("s16_webqa_test", "SELECT p_partkey AS id, p_name AS question, p_brand || ',' || p_type AS answer, array_to_string(list_distinct([p_partkey::VARCHAR]), ',') || CASE WHEN p_partkey % 3 <> 0 THEN ',' || (p_partkey - p_partkey % 3) ELSE '' END AS facts FROM part")
def _(s, d):
    t = prepare.webqa_test(_webqa(s, d))
    return t.select("id", "question", F.array_join("answer", ",").alias("answer"), F.array_join("supporting_facts", ",").alias("facts"))


@query("m10_dataset_key", "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'mmqa' ELSE 'webqa' END AS key, p_partkey % 2 AS side FROM part")
def _(s, d):
    name = F.when(F.col("p_partkey") % 2 == 0, " MMQA_dev").otherwise("my-WebQA")
    return table(s, d, "part").select(prepare.dataset_key(name, ["mmqa", "webqa"]).alias("key"), (F.col("p_partkey") % 2).alias("side")).distinct()


@query("m11_first_existing", "SELECT 'd' || p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '.jpg' ELSE p_partkey || '.png' END AS path FROM part WHERE p_partkey % 3 <> 2")
def _(s, d):
    k = F.col("p_partkey").cast("string")
    c = table(s, d, "part").select(F.concat(F.lit("d"), k).alias("doc_id"), F.posexplode(F.array(F.concat(k, F.lit(".jpg")), F.concat(k, F.lit(".png")))).alias("priority", "path"))
    files = table(s, d, "part").where("p_partkey % 3 < 2").select(F.concat(k, F.when(F.col("p_partkey") % 3 == 0, ".jpg").otherwise(".png")).alias("path")).unionByName(table(s, d, "part").where("p_partkey % 3 = 0").select(F.concat(k, F.lit(".png")).alias("path")))
    return prepare.first_existing(c, files)


@query("m15_question_paths", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '/root/' || p_partkey || '.png' ELSE '/abs/' || p_partkey END AS path FROM part WHERE p_partkey % 4 <> 3")
def _(s, d):
    k = F.col("p_partkey").cast("string")
    p = table(s, d, "part")
    images = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.when(F.col("p_partkey") % 4 == 2, " ").otherwise(F.concat(k, F.lit(".png"))).alias("relative_path"), F.when(F.col("p_partkey") % 4 == 3, "").otherwise(F.concat(F.lit("/abs/"), k)).alias("absolute_path"))
    files = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("/root/"), k, F.lit(".png")).alias("path"))
    return prepare.question_paths(images, files, "/root/").select("id", "path")


@query("m27_linker_mentions", "SELECT p_partkey, p_name || '</s>' AS mention FROM part")
def _(s, d):
    from tierlink.operators.vectors import instructed

    return table(s, d, "part").select("p_partkey", instructed("p_name", True, eos="</s>").alias("mention"))
