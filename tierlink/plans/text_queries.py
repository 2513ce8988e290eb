"""Catalogue of scalar functions: normalisation, parsing, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlink.functions import text as T
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


@query("c01_normalize_phrase", f"SELECT doc_id, {V.NORM.format('text')} AS phrase FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.normalize_phrase("text").alias("phrase"))


@query("c02_normalize_entity", "SELECT doc_id, trim(regexp_replace(lower(trim(text)), '[^0-9a-z]+', ' ', 'g')) AS entity FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.normalize_entity("text").alias("entity"))


@query("c03_alnum_len", "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))::INT AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.alnum_len("text").alias("n"))


@query("c04_extract_json", r"SELECT event_id, coalesce(json_extract_string(regexp_extract('noise ' || props || ' tail', '\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}'), '$.k'), '') AS k FROM events")
def _(s, d):
    wrapped = F.concat(F.lit("noise "), "props", F.lit(" tail"))
    return table(s, d, "events").select("event_id", F.coalesce(F.get_json_object(T.extract_json(wrapped), "$.k"), F.lit("")).alias("k"))


MARKED = "response || ' Answer: ' || answer || chr(10) || 'more'"


def _marked(s, d):
    return V.predictions(s, d).withColumn("full", F.concat("response", F.lit(" Answer: "), "answer", F.lit("\nmore")))


@query("c05_extract_answer", f"WITH {V.PRED} SELECT id, trim(string_split(trim(string_split({MARKED}, 'Answer:')[-1]), chr(10))[1]) AS answer FROM v_pred")
def _(s, d):
    return _marked(s, d).select("id", T.answer_from_response("full").alias("answer"))


@query("c06_em_answer_fallback", f"WITH {V.PRED} SELECT id, CASE WHEN id % 3 = 0 THEN 'given' ELSE trim(string_split({MARKED}, 'Answer:')[2]) END AS answer FROM v_pred")
def _(s, d):
    given = F.when(F.col("id") % 3 == 0, "given").otherwise("")
    return _marked(s, d).select("id", T.em_answer(given, "full").alias("answer"))


@query("c07_rouge_answer_fallback", f"WITH {V.PRED} SELECT id, trim(regexp_replace(trim(string_split(trim(string_split({MARKED}, 'Answer:')[-1]), chr(10))[1]), '\\s+', ' ', 'g')) AS answer FROM v_pred")
def _(s, d):
    return _marked(s, d).select("id", T.rouge_answer(F.lit(""), "full").alias("answer"))


@query("c08_judge_choice", r"""SELECT conv_id, turn, coalesce(nullif(regexp_extract(upper(t), '"CHOICE"\s*:\s*"([AB])"', 1), ''), regexp_extract(upper(t), '(?:^|[^A-Z0-9_])([AB])(?:[^A-Z0-9_]|$)', 1)) AS choice
FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN '{"choice": "b"} ' || text ELSE text END AS t FROM conversations)""")
def _(s, d):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"choice": "b"} '), "text")).otherwise(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", T.judge_choice(t).alias("choice"))


@query("c09_answer_letter", r"""SELECT conv_id, turn, coalesce(nullif(regexp_extract(upper(trim(t)), '^\(?([A-E])\)?[.:]?$', 1), ''), nullif(regexp_extract(upper(trim(t)), '(?:^|[^A-Z0-9_])([A-E])(?:[^A-Z0-9_]|$)', 1), ''), regexp_extract(upper(trim(t)), 'ANSWER:\s*([A-E])', 1)) AS letter
FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN ' (c). ' ELSE text END AS t FROM conversations)""")
def _(s, d):
    t = F.when(F.col("turn") % 3 == 0, F.lit(" (c). ")).otherwise(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", T.answer_letter(t).alias("letter"))


@query("c10_final_letter", r"""WITH t AS (SELECT conv_id, turn, upper(CASE turn % 4 WHEN 0 THEN text || chr(10) || 'Final answer: (d)' WHEN 1 THEN text || chr(10) || '(b)' WHEN 2 THEN 'maybe c here' ELSE 'none' END) AS u FROM conversations)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(u, 'FINAL DECISION\s*:?\s*\(?([A-E])\)?', 1), ''), nullif(regexp_extract(u, 'FINAL ANSWER\s*:?\s*\(?([A-E])\)?', 1), ''), nullif(regexp_extract(u, 'ANSWER\s*:\s*\(?([A-E])\)?', 1), ''),
  nullif(regexp_extract(coalesce(list_filter(list_slice(list_reverse(list_filter(list_transform(string_split(u, chr(10)), lambda x: trim(x)), lambda x: x <> '')), 1, 8), lambda x: regexp_matches(x, '^\(?[A-E]\)?[.:]?$'))[1], ''), '([A-E])', 1), ''),
  coalesce(regexp_extract_all(regexp_replace(u, '([^A-Z0-9_])', ' \1 ', 'g'), '(?:^|[^A-Z0-9_])([A-E])(?:[^A-Z0-9_]|$)', 1)[-1], '')) AS letter FROM t""")
def _(s, d):
    k = F.col("turn") % 4
    t = F.when(k == 0, F.concat("text", F.lit("\nFinal answer: (d)"))).when(k == 1, F.concat("text", F.lit("\n(b)"))).when(k == 2, "maybe c here").otherwise("none")
    return table(s, d, "conversations").select("conv_id", "turn", T.final_letter(t).alias("letter"))


@query("c11_index_letter", "SELECT conv_id, turn, CASE WHEN turn BETWEEN 0 AND 4 THEN chr((65 + turn)::INT) ELSE '' END AS letter FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.index_letter("turn").alias("letter"))


NORM_ANSWER = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query("c12_normalize_answer", f"WITH {V.PRED} SELECT id, {NORM_ANSWER.format('answer')} AS normalized FROM v_pred")
def _(s, d):
    return V.predictions(s, d).select("id", T.normalize_answer("answer").alias("normalized"))


BAG = f"""{V.PRED}, n AS (SELECT id, {NORM_ANSWER.format('response')} AS p, {NORM_ANSWER.format('answer')} AS g FROM v_pred),
pt AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(string_split(p, ' ')) AS w FROM n) WHERE w <> '' GROUP BY ALL), gt AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(string_split(g, ' ')) AS w FROM n) WHERE w <> '' GROUP BY ALL),
o AS (SELECT id, sum(least(pt.c, gt.c))::DOUBLE AS same FROM pt JOIN gt USING (id, w) GROUP BY id), ps AS (SELECT id, sum(c)::DOUBLE AS np FROM pt GROUP BY id), gs AS (SELECT id, sum(c)::DOUBLE AS ng FROM gt GROUP BY id),
f AS (SELECT id, p, g, coalesce(same, 0) AS same, coalesce(same / np, 0) AS precision, coalesce(same / ng, 0) AS recall FROM n LEFT JOIN o USING (id) LEFT JOIN ps USING (id) LEFT JOIN gs USING (id)),
v_f1 AS (SELECT id, (p = g)::INT::DOUBLE AS em, CASE WHEN same = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 9) END AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM f)"""


def _f1(s, d):
    m = V.predictions(s, d).select("id", T.exact_match("response", "answer").alias("em"), T.token_f1("response", "answer").alias("m"))
    return m.select("id", "em", *[F.round(F.col("m")[x], 9).alias(x) for x in ("f1", "precision", "recall")])


@query("c13_token_f1", f"WITH {BAG} SELECT id, f1, precision, recall FROM v_f1")
def _(s, d):
    return _f1(s, d).select("id", "f1", "precision", "recall")


@query("c14_exact_match", f"WITH {BAG} SELECT id, em FROM v_f1")
def _(s, d):
    return _f1(s, d).select("id", "em")


@query("a26_em_f1_summary", f"WITH {BAG} SELECT round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM v_f1")
def _(s, d):
    return _f1(s, d).agg(*[F.round(F.avg(x), 6).alias(x) for x in ("em", "f1", "precision", "recall")])


@query("u04_bag_intersection", f"WITH {BAG} SELECT n.id, coalesce(same, 0)::BIGINT AS same FROM n LEFT JOIN o USING (id)")
def _(s, d):
    p = V.predictions(s, d)
    return p.select("id", T.bag_overlap(T.tokens(T.normalize_answer("response")), T.tokens(T.normalize_answer("answer"))).cast("long").alias("same"))


@query("c15_anchor_weight", r"SELECT p_partkey, CASE WHEN n >= 3 THEN 1.0 WHEN n = 2 THEN 0.9 WHEN length(p_name) >= 10 THEN 0.6 ELSE 0.25 END::DOUBLE AS weight FROM (SELECT *, len(list_filter(string_split_regex(p_name, '\s+'), lambda x: x <> '')) AS n FROM part)")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.anchor_weight("p_name").cast("double").alias("weight"))


@query("c16_safe_number", "SELECT event_id, coalesce(try_cast(v AS DOUBLE), -1) AS number, greatest(0, trunc(try_cast(v AS DOUBLE))::INT) AS whole FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE round(value - 10, 2)::VARCHAR END AS v FROM events)")
def _(s, d):
    v = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.round(F.col("value") - 10, 2).cast("string"))
    x = F.when(T.safe_float(v).isNull(), F.lit(None).cast("int")).otherwise(T.nonnegative_int(v))
    return table(s, d, "events").select("event_id", T.safe_float(v, -1.0).alias("number"), F.coalesce(x, F.lit(0)).alias("whole"))


@query("c18_unquote", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '"' END AS name FROM part""")
def _(s, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.concat("p_name", F.lit('"')))
    return table(s, d, "part").select("p_partkey", T.unquote(t).alias("name"))


@query("c19_buckets", "SELECT doc_id, CASE WHEN g = 14 THEN 'UNKNOWN' WHEN g <= 6 THEN 'G1-6' ELSE 'G7-12' END AS grade, CASE WHEN g % 5 = 4 THEN 'OTHER' WHEN g % 3 = 0 THEN 'NAT' WHEN g % 3 = 1 THEN 'Soc' ELSE 'OTHER' END AS subject, CASE WHEN quality = 1 THEN 'IMG' WHEN toxic = 1 THEN 'TXT' ELSE 'NO' END AS modality FROM (SELECT *, doc_id % 15 AS g FROM labels)")
def _(s, d):
    g = F.col("doc_id") % 15
    grade = F.when(g == 14, "x").otherwise(F.concat(F.lit("Grade"), g.cast("string")))
    subject = F.when(g % 5 == 4, F.lit(None)).when(g % 3 == 0, "Natural Science").when(g % 3 == 1, " social science").otherwise("Art")
    x = table(s, d, "labels").select("doc_id", grade.alias("g"), subject.alias("s"), F.when(F.col("quality") == 1, "a.png").otherwise("null").alias("i"), F.when(F.col("toxic") == 1, "hint").otherwise(" ").alias("h"))
    return x.select("doc_id", T.grade_bucket("g").alias("grade"), T.subject_bucket("s").alias("subject"), T.modality_bucket("i", "h").alias("modality"))


@query("c17_normalize_text", "SELECT conv_id, turn, lower(trim(text)) AS folded, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.fold("text").alias("folded"), T.collapse_spaces("text").alias("collapsed"))


@query("c20_model_label", "SELECT doc_id, CASE quality WHEN 1 THEN '5' ELSE '0' END AS label FROM labels")
def _(s, d):
    reply = F.when(F.col("quality") == 1, "label 5.").otherwise(" 0 ")
    return table(s, d, "labels").select("doc_id", T.model_label(reply).alias("label"))


@query("c21_valid_triples", "SELECT p_partkey, trim(p_name) AS head, trim(p_brand) AS relation, trim(p_type) AS tail FROM part WHERE p_partkey % 3 <> 0")
def _(s, d):
    last = F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "p_type"))
    t = table(s, d, "part").select("p_partkey", T.valid_triple(F.array("p_name", "p_brand", last)).alias("t")).where("t is not null")
    return t.select("p_partkey", F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"))


@query("c22_pattern_parse", "SELECT p_partkey, p_name AS head, 'has brand' AS relation, p_brand AS tail, false AS is_target FROM part UNION ALL SELECT p_partkey, p_name, 'has type', 'UNKNOWN type', true FROM part")
def _(s, d):
    reply = F.concat(F.lit('{"graph": ['), F.lit("("), "p_name", F.lit(", has brand, "), "p_brand", F.lit("), ("), "p_name", F.lit(", has type, UNKNOWN type)]}"))
    t = table(s, d, "part").select("p_partkey", F.explode(T.triples_from_text(reply)).alias("t"))
    return t.select("p_partkey", F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"), F.exists("t", T.is_wildcard).alias("is_target"))


@query("c23_md5_triple_id", f"WITH {V.MICRO_NORM} SELECT triple_id, doc_id FROM v_micro_norm")
def _(s, d):
    return V.micro_normalized(s, d).select("triple_id", "doc_id")


@query("c24_safe_file_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.safe_file_name("url").alias("name"))


@query("c25_entity_list", f"SELECT p_partkey, {V.NORM.format('p_name')} || '|' || {V.NORM.format('p_brand')} AS entities FROM part")
def _(s, d):
    reply = F.concat(F.lit('Sure: {"named_entities": ["'), "p_name", F.lit('", "'), "p_brand", F.lit('"]} done'))
    return table(s, d, "part").select("p_partkey", F.array_join(T.entity_list(reply), "|").alias("entities"))


@query("c26_sorted_distinct", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name, p_brand, p_type, p_brand])), '|') AS entities FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(T.sorted_distinct(F.array(F.array("p_name", "p_brand"), F.array("p_type", "p_brand"))), "|").alias("entities"))


@query("c27_clean_list", "SELECT p_partkey, p_name || '|' || p_brand AS captions FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(T.clean_list(F.array("p_name", F.lit("  "), F.concat(F.lit(" "), "p_brand"), "p_name")), "|").alias("captions"))


@query("c28_sigmoid_log", f"WITH {V.SCORE} SELECT id, round(1 / (1 + exp(-score / 100)), 9) AS p, round(ln(greatest(score, 1e-12)), 9) AS l FROM v_score")
def _(s, d):
    from tierlink.functions.numeric import clamp_log, sigmoid

    return V.scores(s, d).select("id", F.round(sigmoid(F.col("score") / 100), 9).alias("p"), F.round(clamp_log(F.col("score")), 9).alias("l"))


@query("c29_fit_dim", "SELECT vec_id, 16::INT AS n_short, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)), 6) AS s_short, 80::INT AS n_long FROM embeddings")
def _(s, d):
    from tierlink.functions.numeric import fit_dim

    v = F.transform("embedding", lambda x: x.cast("double"))
    short = fit_dim(v, 16)
    return table(s, d, "embeddings").select("vec_id", F.size(short).alias("n_short"), F.round(F.aggregate(short, F.lit(0.0), lambda a, x: a + x), 6).alias("s_short"), F.size(fit_dim(v, 80)).alias("n_long"))


@query("f13_to_bool", "SELECT p_partkey, p_partkey % 4 IN (0, 1) AS flag FROM part")
def _(s, d):
    t = F.element_at(F.array(F.lit(" Yes"), F.lit("TRUE"), F.lit("no"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", T.to_bool(t).alias("flag"))


@query("f12_wildcard", "SELECT p_partkey, p_partkey % 2 = 0 AS wild FROM part")
def _(s, d):
    t = F.when(F.col("p_partkey") % 2 == 0, "UNKNOWN brand").otherwise("unknown brand")
    return table(s, d, "part").select("p_partkey", T.is_wildcard(t).alias("wild"))
