"""Catalogue of graph construction: sources, triples, micro facts, alignment, branches, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.operators import build as B
from tierlink.plans import views as V
from tierlink.session import materialize, table
from tierlink.sources import encode, readers

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("s02_doc_ids", "SELECT DISTINCT coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::VARCHAR END, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source || '-' || doc_id END, 'doc_' || doc_id) AS id FROM documents")
def _(s, d):
    docs = table(s, d, "documents")
    item = docs.select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("doc_id"), F.when(F.col("doc_id") % 2 != 0, F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))).alias("title"), F.col("doc_id").alias("pos"))
    return readers.document_ids(item)


@query("s04_non_blank_ids", "SELECT DISTINCT source AS id FROM documents WHERE trim(source) <> ''")
def _(s, d):
    return readers.non_blank_ids(table(s, d, "documents").select(F.col("source").alias("id")))


ENCODED = V.TRIPLES + """, ends AS (SELECT head AS name, seq * 2 AS p FROM v_triples UNION ALL SELECT tail, seq * 2 + 1 FROM v_triples),
ent AS (SELECT name, row_number() OVER (ORDER BY min(p)) - 1 AS id FROM ends GROUP BY name), rel AS (SELECT relation AS name, row_number() OVER (ORDER BY min(seq)) - 1 AS id FROM v_triples GROUP BY relation)"""


@query("s07_dictionary_encode", f"WITH {ENCODED} SELECT 'entity' AS kind, name, id FROM ent UNION ALL SELECT 'relation', name, id FROM rel")
def _(s, d):
    t = V.triples(s, d)
    ent, rel = encode.dictionaries(t)
    return ent.select(F.lit("entity").alias("kind"), "name", "id").unionByName(rel.select(F.lit("relation").alias("kind"), "name", "id"))


@query("p18_inverse_edges", f"WITH {ENCODED}, e AS (SELECT h.id AS src, t.id AS dst, r.id AS rel FROM v_triples JOIN ent h ON head = h.name JOIN ent t ON tail = t.name JOIN rel r ON relation = r.name) SELECT src, dst, rel FROM e UNION ALL SELECT dst, src, rel + (SELECT count(*) FROM rel) FROM e")
def _(s, d):
    t = V.triples(s, d)
    ent, rel = encode.dictionaries(t)
    return encode.with_inverses(encode.encode_edges(t, ent, rel), rel)


@query("s08_kg_entities", f"WITH {V.TRIPLES} SELECT head AS entity FROM v_triples UNION SELECT tail FROM v_triples")
def _(s, d):
    return readers.graph_entities(V.triples(s, d))


@query("s09_doc_entities", f"WITH {V.DOC_ENT} SELECT doc_id, entity FROM v_doc_ent")
def _(s, d):
    return V.doc_entities(s, d)


@query("s10_corpus_fallback", "SELECT coalesce(d.doc_id, p.page_id) AS doc_id, CASE WHEN d.text IS NULL OR trim(d.text) = '' THEN 'Title: ' || p.url ELSE d.text END AS content FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 1) d FULL JOIN pages p ON d.doc_id = p.page_id WHERE coalesce(nullif(trim(d.text), ''), p.url) IS NOT NULL")
def _(s, d):
    docs = table(s, d, "documents").where("doc_id % 5 <> 1").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"))
    pages = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("Title: "), "url").alias("content"))
    return readers.corpus_with_fallback(docs, pages).where("content is not null")


@query("s11_image_doc_ids", "SELECT DISTINCT 'page_' || page_id AS doc_id FROM pages")
def _(s, d):
    branch = table(s, d, "pages").select(F.concat(F.lit("page_"), "page_id").alias("doc_id"))
    return readers.image_ids([None, branch])


@query("s12_title_index", "SELECT lower(source) AS title, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY 1")
def _(s, d):
    return readers.title_index(table(s, d, "documents").select("doc_id", F.col("source").alias("title"))).select("title", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


BAD = V.TRIPLES + """, x AS (SELECT seq, CASE seq % 7 WHEN 0 THEN [head] WHEN 1 THEN [head, relation] WHEN 2 THEN [head, '--', tail] ELSE [head, relation, tail] END AS items FROM v_triples),
c AS (SELECT seq, items, list_transform(items, lambda x: trim(regexp_replace(lower(x), '[^A-Za-z0-9 ]', ' ', 'g'))) AS t FROM x),
v_clean AS (SELECT seq, CASE WHEN len(t) <= 1 THEN 'ignored' WHEN len(t) = 3 AND len(list_filter(t, lambda x: x = '')) = 0 THEN 'clean' ELSE 'noisy' END AS status, t FROM c)"""


def _raw(s, d):
    k = F.col("seq") % 7
    items = F.when(k == 0, F.array("head")).when(k == 1, F.array("head", "relation")).when(k == 2, F.array(F.col("head"), F.lit("--"), F.col("tail"))).otherwise(F.array("head", "relation", "tail"))
    return B.clean_triples(V.triples(s, d).select("seq", items.alias("items")))


@query("p03_clean_triples", f"WITH {BAD} SELECT seq, status, CASE WHEN status = 'clean' THEN t[1] END AS head, CASE WHEN status = 'clean' THEN t[2] END AS relation, CASE WHEN status = 'clean' THEN t[3] END AS tail FROM v_clean")
def _(s, d):
    return _raw(s, d).select("seq", "status", "head", "relation", "tail")


@query("p04_edge_last_wins", f"WITH {V.TRIPLES}, x AS (SELECT seq, tail AS head, relation, 'x' AS tail FROM v_triples) SELECT head, tail, arg_max(relation, seq) AS relation FROM x GROUP BY head, tail")
def _(s, d):
    return B.last_wins(V.triples(s, d).select("seq", F.col("tail").alias("head"), "relation", F.lit("x").alias("tail")))


@query("p05_table_to_triples", f"WITH {V.MICRO} SELECT * FROM v_micro WHERE modality = 'table'")
def _(s, d):
    return V.micro(s, d).where("modality = 'table'")


@query("p05_list_rows", "SELECT 'd' || p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 't' ELSE p_name END AS head, r AS relation, v AS tail, 'table' AS modality, 't#row' || p_partkey AS source_ref, 0.8::DOUBLE AS confidence FROM (SELECT p_partkey, p_name, unnest(CASE p_partkey % 3 WHEN 0 THEN ['has_value'] WHEN 1 THEN ['brand', 'type'] ELSE ['column_1', 'column_2'] END) AS r, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_name] ELSE [p_brand, p_type] END) AS v FROM part)")
def _(s, d):
    k = F.col("p_partkey") % 3
    headers = F.when(k == 1, F.array(F.lit("name"), F.lit("brand"), F.lit("type"))).otherwise(F.array().cast("array<string>"))
    cells = F.when(k == 0, F.array("p_name")).otherwise(F.array("p_name", "p_brand", "p_type"))
    return B.unpivot_lists(table(s, d, "part").select(F.concat(F.lit("d"), "p_partkey").alias("doc_id"), F.lit("t").alias("table_id"), F.col("p_partkey").alias("row_id"), headers.alias("headers"), cells.alias("cells")))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("p06_caption_fallback", f"SELECT 'page_' || page_id AS doc_id, 'img_' || page_id AS head, 'describes' AS relation, {TITLE} AS tail, 'image' AS modality, 'img_' || page_id AS source_ref, greatest(0.3, 0.7::DOUBLE - 0.2) AS confidence FROM pages WHERE trim({TITLE}) <> ''")
def _(s, d):
    pages = table(s, d, "pages").select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.concat(F.lit("img_"), "page_id").alias("image_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"))
    return B.caption_facts(pages)


@query("p01_image_evidence", "SELECT doc_id, text || chr(10) || 'Image evidence: ' || source || chr(10) || 'Image evidence: ' || lang AS text FROM documents")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "source", "lang")
    notes = docs.select("doc_id", F.posexplode(F.array("source", "lang")).alias("seq", "description"))
    return B.with_evidence(docs.select("doc_id", "text"), notes)


@query("p02_prepend_title", "SELECT doc_id, source || chr(10) || text AS text FROM documents")
def _(s, d):
    return B.with_title(table(s, d, "documents").select("doc_id", "source", "text"), "source").select("doc_id", "text")


@query("p07_doc_content", "SELECT p_partkey, concat_ws(chr(10), 'Title: ' || p_name, 'Image: ' || p_name, 'Table columns: ' || p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'Table row: ' || p_type END) AS content FROM part")
def _(s, d):
    c = B.document_content(F.col("p_name"), F.lit(" "), F.lit(""), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")))
    return table(s, d, "part").select("p_partkey", c.alias("content"))


@query("p08_micro_normalize", f"WITH {V.MICRO_NORM} SELECT * FROM v_micro_norm")
def _(s, d):
    return V.micro_normalized(s, d)


ALIGN = V.MICRO_NORM + ", " + V.TRIPLES + f""", v_macro AS (SELECT DISTINCT {V.NORM.format('e')} AS entity FROM (SELECT head AS e FROM v_triples WHERE relation <> 'has type' UNION ALL SELECT tail FROM v_triples WHERE relation <> 'has type')),
v_align AS (SELECT DISTINCT triple_id, e AS entity FROM (SELECT triple_id, head AS e FROM v_micro_norm UNION ALL SELECT triple_id, tail FROM v_micro_norm) WHERE e IN (SELECT entity FROM v_macro))"""


def _macro(s, d):
    t = V.triples(s, d).where("relation <> 'has type'")
    return t.select(F.explode(F.array("head", "tail")).alias("e")).select(T.normalize_phrase("e").alias("entity")).distinct()


def _align(s, d):
    return B.cross_tier(V.micro_normalized(s, d), _macro(s, d))


@query("j05_cross_tier_index", f"WITH {ALIGN} SELECT triple_id, entity FROM v_align")
def _(s, d):
    return _align(s, d)


@query("p09_micro_merge", f"WITH {ALIGN}, a AS (SELECT triple_id, min(entity) AS anchor FROM v_align GROUP BY 1) SELECT triple_id, anchor, relation, tail FROM v_micro_norm JOIN a USING (triple_id)")
def _(s, d):
    return B.merge_micro(V.micro_normalized(s, d), _align(s, d))


@query("p10_linearize_table", "SELECT p_partkey, 'Table: ' || p_name || chr(10) || 'Columns: brand | type' || chr(10) || 'Row: ' || p_brand || ' | ' || p_type || chr(10) || 'Row: x | y' AS content FROM part")
def _(s, d):
    rows = F.array(F.array("p_brand", "p_type"), F.array(F.lit("x"), F.lit("y")))
    return table(s, d, "part").select("p_partkey", B.linearize_table(F.col("p_name"), F.array(F.lit("brand"), F.lit("type")), rows).alias("content"))


@query("p11_keyed_rows", "SELECT p_partkey, 'brand=' || p_brand || ';col_1=' || p_type AS cells FROM part")
def _(s, d):
    cells = B.keyed_row(F.array(F.lit("brand")), F.array("p_brand", "p_type"))
    return table(s, d, "part").select("p_partkey", F.array_join(F.transform(cells, lambda x: F.concat(x["k"], F.lit("="), x["v"])), ";").alias("cells"))


@query("p13_qa_doc_text", "SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Choices:' || chr(10) || '(A) ' || p_brand || chr(10) || '(B) ' || p_type || chr(10) || 'Answer: ' || CASE p_partkey % 2 WHEN 0 THEN 'A. ' || p_brand ELSE 'B. ' || p_type END || chr(10) || 'why' AS content FROM part")
def _(s, d):
    c = B.question_document(F.col("p_name"), F.array("p_brand", "p_type"), (F.col("p_partkey") % 2).cast("int"), F.lit(" "), F.lit("why"))
    return table(s, d, "part").select("p_partkey", c.alias("content"))


@query("p14_choices", "SELECT p_partkey, '(A) ' || p_brand || chr(10) || '(B) ' || p_type AS choices FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", B.render_choices(F.array("p_brand", "p_type")).alias("choices"))


@query("p16_answers", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS answer, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE p_type END AS aliases FROM part")
def _(s, d):
    a = B.answers_of(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(""), F.array("p_brand", "p_type", "p_brand"))
    return table(s, d, "part").select("p_partkey", a["answer"].alias("answer"), F.array_join(a["aliases"], "|").alias("aliases"))


@query("p17_media_path", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'media/' || page_id || '.png' END AS path FROM pages")
def _(s, d):
    p = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".png")))
    return table(s, d, "pages").select("page_id", B.media_path(p, "media").alias("path"))


F1 = V.MICRO_NORM + """, v_f1 AS (SELECT * FROM v_micro_norm WHERE confidence >= 0.5 AND length(regexp_replace(head, '[^A-Za-z0-9]', '', 'g')) >= 2 AND length(regexp_replace(tail, '[^A-Za-z0-9]', '', 'g')) >= 2
  QUALIFY row_number() OVER (PARTITION BY doc_id, head, relation, tail ORDER BY source_ref, triple_id) = 1)"""


@query("f01_micro_filter", f"WITH {F1} SELECT triple_id, doc_id FROM v_f1 WHERE relation IN ('p brand', 'describes')")
def _(s, d):
    return B.filter_micro(V.micro_normalized(s, d), ["p brand", "describes"]).select("triple_id", "doc_id")


@query("f02_prune_unaligned", f"WITH {ALIGN} SELECT triple_id, confidence FROM v_micro_norm WHERE triple_id IN (SELECT triple_id FROM v_align) OR confidence >= 0.7")
def _(s, d):
    return B.prune_unaligned(V.micro_normalized(s, d), _align(s, d)).select("triple_id", "confidence")


@query("j12_incident_triples", f"WITH {V.MICRO_NORM} SELECT DISTINCT node, triple_id FROM (SELECT head AS node, triple_id FROM v_micro_norm UNION ALL SELECT tail, triple_id FROM v_micro_norm)")
def _(s, d):
    return B.incident_triples(V.micro_normalized(s, d))


@query("j08_supporting_entities", f"WITH {V.DOC_ENT} SELECT id AS sample_id, doc_id, entity FROM (SELECT doc_id AS id, doc_id FROM labels UNION SELECT doc_id, doc_id + 1 FROM labels) JOIN v_doc_ent USING (doc_id)")
def _(s, d):
    x = F.col("doc_id")
    samples = table(s, d, "labels").select(x.alias("sample_id"), F.array(x, x + 1, x).alias("supporting_facts"))
    return B.supporting_entities(samples, V.doc_entities(s, d))


BRANCH = V.DOC_ENT + """, macro AS (SELECT entity FROM v_doc_ent GROUP BY entity HAVING count(*) BETWEEN 5 AND 50), img AS (SELECT doc_id, entity FROM v_doc_ent JOIN labels USING (doc_id) WHERE quality = 0),
tab AS (SELECT doc_id, min(entity) AS entity FROM v_doc_ent GROUP BY 1), allowed AS (SELECT doc_id FROM labels)"""


def _branch(s, d):
    de, lab = materialize(V.doc_entities(s, d)), table(s, d, "labels")  # read four times
    macro = de.groupBy("entity").agg(F.count("*").alias("n")).where("n between 5 and 50").select("entity")
    image = de.join(lab.where("quality = 0").select("doc_id"), "doc_id")
    return de, macro, image, de.groupBy("doc_id").agg(F.min("entity").alias("entity")), lab.select("doc_id")


@query("j10_text_branch", f"WITH {BRANCH}, b AS (SELECT doc_id, entity FROM v_doc_ent WHERE entity IN (SELECT entity FROM macro) EXCEPT SELECT doc_id, entity FROM img), u AS (SELECT * FROM b UNION SELECT * FROM tab) SELECT doc_id, entity FROM (SELECT DISTINCT doc_id FROM allowed) LEFT JOIN u USING (doc_id)")
def _(s, d):
    de, macro, image, tab, allowed = _branch(s, d)
    return B.text_branch(de, macro, image, tab, allowed).select("doc_id", "entity")


@query("j11_image_branch", f"WITH {BRANCH} SELECT doc_id, entity FROM (SELECT * FROM img UNION SELECT * FROM tab) WHERE entity IN (SELECT entity FROM macro) AND doc_id IN (SELECT doc_id FROM allowed)")
def _(s, d):
    _, macro, image, tab, allowed = _branch(s, d)
    return B.image_branch(image, tab, macro, allowed)


@query("w22_capped_descriptions", r"SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, left(event_type || ' ' || props, 12) AS description FROM events QUALIFY rank <= 3")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit("  "), "props").alias("description"))
    return B.capped_descriptions(e, 3, 12).select("doc_id", F.col("rank").cast("long").alias("rank"), "description")


@query("a14_graph_stats", f"""WITH {BAD}, k AS (SELECT t[1] AS h, t[2] AS r, t[3] AS t FROM v_clean WHERE status = 'clean'), e AS (SELECT h, t, max(r) AS r FROM k GROUP BY 1, 2)
SELECT (SELECT count(*) FROM v_clean) AS n_triples, (SELECT count(*) FROM v_clean WHERE status = 'noisy') AS n_noisy, (SELECT count(DISTINCT (h, r, t)) FROM k) AS n_unique_triples, (SELECT count(DISTINCT r) FROM k) AS n_unique_relations,
2 * (SELECT count(*) FROM k) AS n_phrases, (SELECT count(DISTINCT x) FROM (SELECT h AS x FROM k UNION ALL SELECT t FROM k)) AS n_unique_phrases, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM e WHERE r = 'equivalent') AS n_synonymy""")
def _(s, d):
    raw = _raw(s, d)
    return B.graph_stats(raw, B.last_wins(raw.where("status = 'clean'")))


@query("a15_mmkg_stats", f"WITH {ALIGN}, n AS (SELECT (SELECT count(DISTINCT doc_id) FROM v_micro) AS n_docs, (SELECT count(DISTINCT doc_id) FROM v_micro_norm) AS n_docs_with_facts, (SELECT count(*) FROM v_micro_norm) AS n_facts, (SELECT count(DISTINCT triple_id) FROM v_align) AS n_aligned) SELECT *, n_aligned / n_facts AS coverage, n_facts / n_docs AS facts_per_doc FROM n")
def _(s, d):
    return B.micro_stats(V.micro(s, d), V.micro_normalized(s, d), _align(s, d))


@query("a16_index_validation", f"WITH {ALIGN}, j AS (SELECT m.*, triple_id IN (SELECT triple_id FROM v_align) AS l FROM v_micro_norm m), r AS (SELECT count(*) AS n, avg(l::INT) AS coverage, avg((NOT l)::INT) AS unresolved, 1 - count(DISTINCT (doc_id, head, relation, tail)) / count(*) AS duplicates, avg((trim(head) = '' OR trim(tail) = '')::INT) AS empty FROM j) SELECT *, coverage >= 0.6 AND unresolved <= 0.4 AND duplicates <= 0.3 AS ok FROM r")
def _(s, d):
    return B.validate_index(V.micro_normalized(s, d), _align(s, d))
