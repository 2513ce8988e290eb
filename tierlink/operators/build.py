"""Graph construction: triple cleaning, table unpivoting, micro facts, cross-tier alignment, branches.

All operators are DataFrame -> DataFrame without actions. Order-dependent rules ("last wins",
"first wins") take an explicit ``seq`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlink.functions import text as T

TABLE_CONFIDENCE = 0.8
CAPTION_CONFIDENCE = 0.5
CAPTION_FLOOR = 0.3
MIN_CONFIDENCE = 0.5
MIN_UNALIGNED_CONFIDENCE = 0.7
MIN_ALNUM = 2
LINK_THRESHOLD = 0.75
LINK_TOP_K = 3


# -- P1, P2, P7, P10-P14: document and table texts ---------------------------------------------
def with_evidence(docs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(doc_id, text) with one ``Image evidence:`` line for each description of the document."""
    lines = descriptions.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "description"))), lambda x: F.concat(F.lit("Image evidence: "), x["description"])), "\n").alias("__e"))
    return docs.join(lines, "doc_id", "left").withColumn("text", F.concat_ws("\n", "text", "__e")).drop("__e")


def with_title(docs: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """The title on a line of its own before the text."""
    return docs.withColumn(text, F.concat(F.col(title), F.lit("\n"), F.col(text)))


def non_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def document_content(title: Column, text: Column, caption: Column, columns: Column, first_row: Column) -> Column:
    """The stated parts of a multimodal document that aren't blank, a line each."""
    def line(label: str, c: Column) -> Column:
        return F.concat(F.lit(label), non_blank(c))

    return F.concat_ws("\n", line("Title: ", title), non_blank(text), line("Image: ", F.coalesce(non_blank(caption), title)), line("Table columns: ", columns), line("Table row: ", first_row))


def linearize_table(title: Column, headers: Column, rows: Column) -> Column:
    """P10: ``Table:``, ``Columns:`` and ``Row:`` lines; cells joined by `` | ``."""
    body = F.transform(rows, lambda r: F.concat(F.lit("Row: "), F.array_join(r, " | ", "")))
    return F.concat_ws("\n", F.concat(F.lit("Table: "), title), F.concat(F.lit("Columns: "), F.array_join(headers, " | ")), F.array_join(body, "\n"))


def keyed_row(headers: Column, cells: Column) -> Column:
    """(key, value) of each cell; cells beyond the headers get ``col_{index}``."""
    return F.transform(cells, lambda x, i: F.struct(F.coalesce(F.get(headers, i), F.concat(F.lit("col_"), i.cast("string"))).alias("k"), x.alias("v")))


def render_choices(choices: Column) -> Column:
    """``(A) first`` and so on, a line each."""
    return F.array_join(F.transform(choices, lambda x, i: F.concat(F.lit("("), T.index_letter(i), F.lit(") "), x)), "\n")


def question_document(question: Column, choices: Column, answer: Column, lecture: Column, solution: Column) -> Column:
    """Question, lettered choices, answer, and the lecture or else the solution."""
    letter = T.index_letter(answer)
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.concat(F.lit("Choices:\n"), render_choices(choices)), F.concat(F.lit("Answer: "), letter, F.lit(". "), F.get(choices, answer)), F.coalesce(non_blank(lecture), non_blank(solution)))


def answers_of(answer: Column, answers: Column) -> Column:
    """struct(answer, aliases): ``answer`` before ``answers``; the first is the answer, the rest aliases."""
    every = F.array_distinct(F.filter(F.concat(F.array(answer), F.coalesce(answers, F.array().cast("array<string>"))), lambda x: F.trim(x) != ""))
    return F.struct(F.coalesce(F.get(every, F.lit(0)), F.lit("")).alias("answer"), F.slice(every, 2, 1_000_000).alias("aliases"))


def media_path(path: Column, root: str) -> Column:
    """URLs and absolute paths as they are, others below ``root``."""
    return F.when(path.rlike("^(https?://|/)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


# -- P3-P6: triples ------------------------------------------------------------------------------
def clean_triples(extracted: DataFrame, items: str = "items") -> DataFrame:
    """Adds (status, head, relation, tail): ``clean``, ``noisy`` or ``ignored`` (one item or none)."""
    t = F.transform(F.col(items), T.normalize_phrase)
    ok = (F.size(t) == 3) & F.forall(t, lambda x: x != "")
    status = F.when(F.coalesce(F.size(t), F.lit(0)) <= 1, "ignored").when(ok, "clean").otherwise("noisy")
    out = extracted.withColumn("__t", t).withColumn("status", status)
    return out.withColumns({n: F.when(F.col("status") == "clean", F.col("__t")[i]) for i, n in enumerate(("head", "relation", "tail"))}).drop("__t")


def last_wins(triples: DataFrame, seq: str = "seq") -> DataFrame:
    """One relation for each ordered pair, the one with the largest ``seq``."""
    return triples.groupBy("head", "tail").agg(F.max_by("relation", seq).alias("relation"))


def unpivot_rows(rows: DataFrame, ids: list[str], subject: str, columns: list[str]) -> DataFrame:
    """P5 for rows with names: (subject, column, value) facts of a table, nulls skipped.

    ``ids``: doc_id, table_id, row_id.
    """
    doc, tab, row = ids
    long = rows.unpivot([doc, tab, row, subject], columns, "relation", "tail").where(F.col("tail").isNotNull() & F.col(subject).isNotNull())
    return long.select(F.col(doc).cast("string").alias("doc_id"), F.col(subject).alias("head"), "relation", "tail", F.lit("table").alias("modality"), F.concat(F.col(tab), F.lit("#row"), F.col(row).cast("string")).alias("source_ref"), F.lit(TABLE_CONFIDENCE).alias("confidence"))


def unpivot_lists(rows: DataFrame) -> DataFrame:
    """P5 for list rows: (doc_id, table_id, row_id, headers, cells) to facts; without headers the relation is ``column_{i}``,
    and a row of one cell gives (table, ``has_value``, cell)."""
    cells = rows.withColumn("wide", F.size("cells") > 1).select("*", F.posexplode("cells").alias("i", "value")).where("value is not null and (i > 0 or not wide)")
    fits = F.size("headers") == F.size("cells")
    relation = F.when(~F.col("wide"), F.lit("has_value")).when(fits, F.get("headers", F.col("i"))).otherwise(F.concat(F.lit("column_"), F.col("i").cast("string")))
    head = F.when(F.col("wide"), F.col("cells")[0]).otherwise(F.col("table_id"))
    return cells.select("doc_id", head.alias("head"), relation.alias("relation"), F.col("value").alias("tail"), F.lit("table").alias("modality"), F.concat("table_id", F.lit("#row"), F.col("row_id").cast("string")).alias("source_ref"), F.lit(TABLE_CONFIDENCE).alias("confidence")).where("head is not null")


def caption_facts(images: DataFrame, confidence: float = 0.7) -> DataFrame:
    """(image_id, describes, caption) where a model gave no triple; confidence lowered, not below the floor."""
    return images.where(F.trim("caption") != "").select("doc_id", F.col("image_id").alias("head"), F.lit("describes").alias("relation"), F.col("caption").alias("tail"), F.lit("image").alias("modality"), F.col("image_id").alias("source_ref"), F.greatest(F.lit(CAPTION_FLOOR), F.lit(confidence - 0.2)).alias("confidence"))


# -- P8, F1, F2: micro facts ---------------------------------------------------------------------
def normalize_micro(facts: DataFrame) -> DataFrame:
    """Normalised facts without empty parts, with their MD5 id."""
    n = facts.withColumns({c: T.normalize_phrase(c) for c in ("head", "relation", "tail")}).where("head <> '' and relation <> '' and tail <> ''")
    return n.select(T.fingerprint("doc_id", "modality", "head", "relation", "tail", "source_ref").alias("triple_id"), "head", "relation", "tail", "modality", "source_ref", "confidence", "doc_id")


def filter_micro(facts: DataFrame, relations: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE, min_alnum: int = MIN_ALNUM) -> DataFrame:
    """confident facts with long enough ends and listed relations; of equal (doc, h, r, t) the first by source."""
    ok = facts.where((F.col("confidence") >= min_confidence) & (T.alnum_len("head") >= min_alnum) & (T.alnum_len("tail") >= min_alnum))
    if relations:
        ok = ok.where(F.col("relation").isin([r.lower() for r in relations]))
    order = Window.partitionBy("doc_id", "head", "relation", "tail").orderBy("source_ref", "triple_id")
    return ok.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def cross_tier(facts: DataFrame, entities: DataFrame, candidates: DataFrame | None = None, threshold: float = LINK_THRESHOLD, top_k: int = LINK_TOP_K) -> DataFrame:
    """(triple_id, entity): an end that is a macro entity links to itself, others to near candidates.

    ``candidates``: (mention, entity, norm_score) of the linker for the remaining ends.
    """
    ends = facts.select("triple_id", F.explode(F.array_distinct(F.array("head", "tail"))).alias("mention"))
    macro = entities.select(F.col("entity").alias("mention")).distinct()
    exact = ends.join(macro, "mention", "left_semi").select("triple_id", F.col("mention").alias("entity"))
    if candidates is None:
        return exact.distinct()
    best = Window.partitionBy("mention").orderBy(F.col("norm_score").desc(), "entity")
    near = candidates.withColumn("__n", F.row_number().over(best)).where((F.col("__n") <= top_k) & (F.col("norm_score") >= threshold)).select("mention", "entity")
    rest = ends.join(macro, "mention", "left_anti").join(near, "mention").select("triple_id", "entity")
    return exact.unionByName(rest).distinct()


def prune_unaligned(facts: DataFrame, align: DataFrame, min_confidence: float = MIN_UNALIGNED_CONFIDENCE) -> DataFrame:
    """facts with a linked entity or enough confidence."""
    linked = align.select("triple_id").distinct().withColumn("__l", F.lit(True))
    return facts.join(linked, "triple_id", "left").where(F.col("__l") | (F.col("confidence") >= min_confidence)).drop("__l")


def merge_micro(facts: DataFrame, align: DataFrame) -> DataFrame:
    """(anchor, relation, tail) with the least aligned entity as anchor."""
    anchor = align.groupBy("triple_id").agg(F.min("entity").alias("anchor"))
    return facts.join(anchor, "triple_id").select("triple_id", "anchor", "relation", "tail")


def incident_triples(facts: DataFrame) -> DataFrame:
    """(node, triple_id) for both ends."""
    return facts.select(F.explode(F.array("head", "tail")).alias("node"), "triple_id").distinct()


# -- J8, J10, J11: documents and entities ---------------------------------------------------------
def supporting_entities(samples: DataFrame, doc_entity: DataFrame) -> DataFrame:
    """(sample_id, entity) of the distinct supporting documents, repeats between documents kept."""
    facts = samples.select("sample_id", F.explode(F.array_distinct("supporting_facts")).alias("doc_id"))
    return facts.join(doc_entity, "doc_id").select("sample_id", "doc_id", "entity")


def text_branch(doc_entity: DataFrame, macro: DataFrame, image: DataFrame, table_aligned: DataFrame, allowed: DataFrame) -> DataFrame:
    """Macro entities of allowed documents less image ones, with table-aligned ones; a document without any keeps a null."""
    base = doc_entity.join(macro.select("entity").distinct(), "entity", "left_semi").join(image.select("doc_id", "entity").distinct(), ["doc_id", "entity"], "left_anti")
    both = base.select("doc_id", "entity").unionByName(table_aligned.select("doc_id", "entity")).distinct()
    return allowed.select("doc_id").distinct().join(both, "doc_id", "left")


def image_branch(described: DataFrame, aligned: DataFrame, macro: DataFrame, allowed: DataFrame) -> DataFrame:
    """Described and aligned entities in the macro graph of allowed documents."""
    both = described.select("doc_id", "entity").unionByName(aligned.select("doc_id", "entity")).distinct()
    return both.join(macro.select("entity").distinct(), "entity", "left_semi").join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "entity")


def capped_descriptions(images: DataFrame, most: int = 3, chars: int = 240) -> DataFrame:
    """The first ``most`` descriptions of a document, spaces collapsed, cut to ``chars``."""
    first = Window.partitionBy("doc_id").orderBy("seq")
    text = F.substring(T.collapse_spaces("description"), 1, chars)
    return images.withColumn("description", text).where("description <> ''").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


# -- A14-A16: statistics --------------------------------------------------------------------------
def graph_stats(raw: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters of extracted and collapsed triples (``raw`` from ``clean_triples``)."""
    clean = raw.where("status = 'clean'")
    ends = clean.select(F.explode(F.array("head", "tail")).alias("e"))
    a = raw.agg(F.count("*").alias("n_triples"), F.count_if(F.col("status") == "noisy").alias("n_noisy"))
    b = clean.agg(F.count_distinct("head", "relation", "tail").alias("n_unique_triples"), F.count_distinct("relation").alias("n_unique_relations"))
    c = ends.agg(F.count("*").alias("n_phrases"), F.count_distinct("e").alias("n_unique_phrases"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("relation") == "equivalent").alias("n_synonymy"))
    return a.crossJoin(b).crossJoin(c).crossJoin(e)  # one row each


def micro_stats(docs: DataFrame, facts: DataFrame, align: DataFrame) -> DataFrame:
    """Documents, documents with facts, facts, aligned facts, coverage, facts a document."""
    n = docs.agg(F.count_distinct("doc_id").alias("n_docs"))
    f = facts.agg(F.count_distinct("doc_id").alias("n_docs_with_facts"), F.count("*").alias("n_facts"))
    a = align.agg(F.count_distinct("triple_id").alias("n_aligned"))
    one = n.crossJoin(f).crossJoin(a)
    return one.withColumns({"coverage": F.coalesce(F.try_divide("n_aligned", "n_facts"), F.lit(0.0)), "facts_per_doc": F.coalesce(F.try_divide("n_facts", "n_docs"), F.lit(0.0))})


def validate_index(facts: DataFrame, align: DataFrame, min_coverage: float = 0.6, max_unresolved: float = 0.4, max_duplicates: float = 0.3) -> DataFrame:
    """Coverage, unresolved, duplicate and empty ratios, and whether they are in bounds."""
    linked = align.select("triple_id").distinct().withColumn("__l", F.lit(1))
    j = facts.join(linked, "triple_id", "left")
    n = F.count("*")
    m = j.agg(
        n.alias("n"),
        F.coalesce(F.try_divide(F.count("__l"), n), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.try_divide(F.count_if(F.col("__l").isNull()), n), F.lit(0.0)).alias("unresolved"),
        F.coalesce(1 - F.try_divide(F.count_distinct("doc_id", "head", "relation", "tail"), n), F.lit(0.0)).alias("duplicates"),
        F.coalesce(F.try_divide(F.count_if((F.trim("head") == "") | (F.trim("tail") == "")), n), F.lit(0.0)).alias("empty"),
    )
    return m.withColumn("ok", (F.col("coverage") >= min_coverage) & (F.col("unresolved") <= max_unresolved) & (F.col("duplicates") <= max_duplicates))
