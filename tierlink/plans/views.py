"""Canonical inputs of the query catalogue, derived from the driver's tables.

Each view exists once in DataFrame form and once as SQL (``CTE``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.operators.containment import containing
from tierlink.session import table

BIG = 1_000_000_000


def triples(spark: SparkSession, d: str) -> DataFrame:
    """(seq, head, relation, tail) facts of the star schema in a fixed order."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    customer, supplier, part = (table(spark, d, t) for t in ("customer", "supplier", "part"))

    def rows(df: DataFrame, kind: int, key: str, head: str, relation: str, tail: str) -> DataFrame:
        return df.select((F.lit(kind).cast("long") * BIG + F.col(key)).alias("seq"), F.lower(head).alias("head"), F.lit(relation).alias("relation"), F.lower(tail).alias("tail"))

    parts = [
        rows(nation.join(region, nation.n_regionkey == region.r_regionkey), 0, "n_nationkey", "n_name", "in region", "r_name"),
        rows(customer.join(nation, customer.c_nationkey == nation.n_nationkey), 1, "c_custkey", "c_name", "in nation", "n_name"),
        rows(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey), 2, "s_suppkey", "s_name", "in nation", "n_name"),
        rows(part, 3, "p_partkey", "p_name", "has brand", "p_brand"),
        rows(part, 4, "p_partkey", "p_name", "has type", "p_type"),
        rows(customer, 5, "c_custkey", "c_name", "in segment", "c_mktsegment"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRIPLES = """v_triples AS (
  SELECT n_nationkey::BIGINT AS seq, lower(n_name) AS head, 'in region' AS relation, lower(r_name) AS tail FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000000 + c_custkey, lower(c_name), 'in nation', lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 2000000000 + s_suppkey, lower(s_name), 'in nation', lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 3000000000 + p_partkey, lower(p_name), 'has brand', lower(p_brand) FROM part
  UNION ALL SELECT 4000000000 + p_partkey, lower(p_name), 'has type', lower(p_type) FROM part
  UNION ALL SELECT 5000000000 + c_custkey, lower(c_name), 'in segment', lower(c_mktsegment) FROM customer)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (head, relation, tail) of ``triples``, the last relation of a pair winning."""
    return triples(spark, d).groupBy("head", "tail").agg(F.max_by("relation", "seq").alias("relation"))


EDGES = TRIPLES + ", v_edges AS (SELECT head, tail, arg_max(relation, seq) AS relation FROM v_triples GROUP BY head, tail)"


def doc_entities(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (doc_id, entity): phrase tokens of at least four characters.

    Words are made distinct in their row, which is all there is to do for a doc_id of one row: only
    those of several rows, if there are any, go through a shuffle.
    """
    words = F.array_distinct(F.filter(F.split(T.normalize_phrase("text"), " "), lambda w: F.length(w) >= 4))
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", F.explode(words).alias("entity"))
    several = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return found if several.isEmpty() else found.distinct()


DOC_ENT = """v_doc_ent AS (SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^A-Za-z0-9 ]', ' ', 'g')), ' ')) AS entity FROM documents) WHERE length(entity) >= 4)"""


def seeds(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """(sample_id, entity, w): term frequencies of benchmark tokens that documents contain; ``docs``: a stored ``doc_entities``."""
    words = F.explode(F.filter(F.split(T.normalize_phrase("text"), " "), lambda w: F.length(w) >= 4))
    raw = table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), words.alias("entity")).groupBy("sample_id", "entity").agg(F.count("*").cast("double").alias("w"))
    known = (docs if docs is not None else doc_entities(spark, d)).select("entity")
    return raw.join(known.join(raw.select("entity").distinct(), "entity", "left_semi").distinct(), "entity", "left_semi").select("sample_id", "entity", "w")


SEEDS = DOC_ENT + """, v_seed AS (SELECT sample_id, entity, count(*)::DOUBLE AS w FROM (SELECT item_id AS sample_id, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^A-Za-z0-9 ]', ' ', 'g')), ' ')) AS entity FROM benchmark)
  WHERE length(entity) >= 4 AND entity IN (SELECT entity FROM v_doc_ent) GROUP BY ALL)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(id, response, answer): an assistant turn and the user turn after it."""
    c = table(spark, d, "conversations")
    later = Window.partitionBy("conv_id").orderBy("turn")
    wide = c.withColumn("next_role", F.lead("role").over(later)).withColumn("answer", F.lead("text").over(later))
    return wide.where("role = 'assistant' and next_role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("response"), "answer")


PRED = """v_pred AS (SELECT conv_id * 1000 + turn AS id, text AS response, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND next_role = 'user')"""


def micro(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, head, relation, tail, modality, source_ref, confidence): table facts of part, customer and supplier, page titles as captions."""
    from tierlink.operators.build import unpivot_rows

    part = unpivot_rows(table(spark, d, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("doc_id"), F.lit("part").alias("table_id"), F.col("p_partkey").alias("row_id"), "p_name", "p_brand", "p_type"), ["doc_id", "table_id", "row_id"], "p_name", ["p_brand", "p_type"])
    customer = unpivot_rows(table(spark, d, "customer").select(F.concat(F.lit("customer_"), "c_custkey").alias("doc_id"), F.lit("customer").alias("table_id"), F.col("c_custkey").alias("row_id"), "c_name", "c_mktsegment"), ["doc_id", "table_id", "row_id"], "c_name", ["c_mktsegment"])
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, d, "pages").select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.concat(F.lit("img_"), "page_id").alias("head"), F.lit("describes").alias("relation"), title.alias("tail"), F.lit("image").alias("modality"), F.concat(F.lit("img_"), "page_id").alias("source_ref"), F.lit(0.5).alias("confidence"))
    return part.unionByName(customer).unionByName(pages)


MICRO = """v_micro AS (
  SELECT 'part_' || p_partkey AS doc_id, p_name AS head, 'p_brand' AS relation, p_brand AS tail, 'table' AS modality, 'part#row' || p_partkey AS source_ref, 0.8::DOUBLE AS confidence FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL
  UNION ALL SELECT 'part_' || p_partkey, p_name, 'p_type', p_type, 'table', 'part#row' || p_partkey, 0.8 FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL
  UNION ALL SELECT 'customer_' || c_custkey, c_name, 'c_mktsegment', c_mktsegment, 'table', 'customer#row' || c_custkey, 0.8 FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL
  UNION ALL SELECT 'page_' || page_id, 'img_' || page_id, 'describes', regexp_extract(html, '<title>([^<]*)</title>', 1), 'image', 'img_' || page_id, 0.5 FROM pages)"""

NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^A-Za-z0-9 ]', ' ', 'g'))"
MICRO_NORM = MICRO + f""", v_micro_norm AS (SELECT md5(concat_ws('|', doc_id, modality, h, r, t, source_ref)) AS triple_id, h AS head, r AS relation, t AS tail, modality, source_ref, confidence, doc_id
  FROM (SELECT *, {NORM.format('head')} AS h, {NORM.format('relation')} AS r, {NORM.format('tail')} AS t FROM v_micro) WHERE h <> '' AND r <> '' AND t <> '')"""


def micro_normalized(spark: SparkSession, d: str) -> DataFrame:
    from tierlink.operators.build import normalize_micro

    return normalize_micro(micro(spark, d))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(sample, id, score, target): event values grouped by event type as model-free scores."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("sample"), F.col("event_id").alias("id"), F.col("value").cast("double").alias("score"), (F.pmod(F.col("event_id"), F.lit(7)) == 0).cast("int").alias("target"))


SCORE = "v_score AS (SELECT event_type AS sample, event_id AS id, value::DOUBLE AS score, (event_id % 7 = 0)::INT AS target FROM events)"


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, doc_id): documents that hold a benchmark text whole."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), "text")
    return containing(table(spark, d, "documents").select("doc_id", "text"), items, "doc_id", "sample_id").select("sample_id", "doc_id")


GOLD = "v_gold AS (SELECT item_id AS sample_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def buckets(spark: SparkSession, d: str) -> DataFrame:
    """(id, subject, grade, correct): labels with the document's language and source."""
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("grade"), F.col("quality").alias("correct"), F.col("toxic").alias("other"))


BUCKETS = "v_buckets AS (SELECT doc_id AS id, lang AS subject, source AS grade, quality AS correct, toxic AS other FROM labels JOIN documents USING (doc_id))"
