"""Prompts, arbitration and context assembly as Column and DataFrame expressions; models are hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATTERN_PROMPT = "Rewrite the question as triples (head, relation, tail). Write UNKNOWN with a number for what is asked or not named."
IMAGE_TRIPLE_PROMPT = "List the facts that this image shows as triples (head, relation, tail)."
NER_PROMPT = 'List the names of people, places, works, organisations, dates and other things in the text. Reply with JSON: {"named_entities": [...]}'
OPENIE_PROMPT = 'State what the text says of the listed names as triples of head, relation and tail; each has one of the names at least, and pronouns are resolved. Reply with JSON: {"triples": [[...], ...]}'
ONE_SHOT = ("Ada Lovelace published notes in 1843.", '{"named_entities": ["Ada Lovelace", "1843"]}', '{"triples": [["Ada Lovelace", "published", "notes"], ["notes", "published in", "1843"]]}')
MAX_PATH_LINKS = 1


def chat_prompt(messages: DataFrame, system: str) -> DataFrame:
    """(conv_id, prompt): the system line and then each turn as ``role: text``."""
    turns = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return messages.groupBy("conv_id").agg(F.concat(F.lit(f"system: {system}\n"), turns).alias("prompt"))


def ner_prompt(text: Column) -> Column:
    """Instruction, one worked example and the text for entity recognition."""
    return F.concat_ws("\n", F.lit(NER_PROMPT), F.lit(f"Text: {ONE_SHOT[0]}"), F.lit(ONE_SHOT[1]), F.concat(F.lit("Text: "), text))


def openie_prompt(text: Column, entities: Column) -> Column:
    """Instruction, one worked example, the text and its names for triple extraction."""
    names = F.to_json(F.struct(entities.alias("named_entities")))
    return F.concat_ws("\n", F.lit(OPENIE_PROMPT), F.lit(f"Text: {ONE_SHOT[0]}"), F.lit(ONE_SHOT[1]), F.lit(ONE_SHOT[2]), F.concat(F.lit("Text: "), text), names)


def path_prompt(question: Column, docs: Column, links: Column, slots: int = 5) -> Column:
    """Numbered document slots (missing ones empty), links and the question."""
    lines = [F.concat(F.lit(f"doc{i + 1}: "), F.coalesce(F.get(docs, F.lit(i)), F.lit(""))) for i in range(slots)]
    return F.concat_ws("\n", *lines, F.concat(F.lit("links: "), links), F.concat(F.lit("question: "), question))


def standard_prompt(few_shot: Column, docs: Column, question: Column) -> Column:
    """Few-shot blocks, documents and the question, a line each."""
    return F.concat_ws("\n", F.array_join(few_shot, "\n"), F.array_join(docs, "\n"), F.concat(F.lit("Question: "), question))


def path_links(relations: DataFrame, top: DataFrame, most: int = MAX_PATH_LINKS) -> DataFrame:
    """T4, T5: (sample, text) of the strongest links whose documents are both among the top ones, by alias ``doc{n}``."""
    alias = top.select("sample", "doc", F.concat(F.lit("doc"), F.col("rank").cast("string")).alias("alias"))
    both = relations.join(alias.toDF("sample", "a", "alias_a"), ["sample", "a"]).join(alias.toDF("sample", "b", "alias_b"), ["sample", "b"])
    order = Window.partitionBy("sample").orderBy(F.col("score").desc(), "a", "b")
    best = both.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= min(most, MAX_PATH_LINKS))
    return best.select("sample", F.concat("alias_a", F.lit(" - "), "alias_b").alias("text"))


def answer_prompt(question: Column, choices: Column, context: Column) -> Column:
    """Context, question and lettered choices of a multiple-choice question."""
    from tierlink.operators.build import render_choices

    return F.concat_ws("\n", F.concat(F.lit("Context: "), context), F.concat(F.lit("Question: "), question), render_choices(choices), F.lit("Answer with one letter."))


def describe_prompt(title: Column, caption: Column) -> Column:
    """The description that stands in without a vision model: ``title. caption``."""
    return F.concat_ws(". ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(caption), F.lit("")))


def few_shot_prompt(examples: DataFrame, per_class: int = 8) -> DataFrame:
    """(label, text) of the first ``per_class`` examples of each label, a line each."""
    first = Window.partitionBy("label").orderBy("id")
    kept = examples.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_class)
    return kept.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "question"))), lambda x: F.concat(F.lit("Q: "), x["question"])), "\n").alias("text"))


def arbitrate(rows: DataFrame) -> DataFrame:
    """Final answer and its source of (direct, rag, judge): agreement, judge's choice, or fallbacks."""
    d, r, j = F.col("direct"), F.col("rag"), F.col("judge")
    source = F.when((d == "") & (r == ""), "none").when(d == r, "auto_agree").when(j == "A", "judge_direct").when(j == "B", "judge_rag").otherwise("fallback")
    final = F.when(F.col("source") == "none", "").when(F.col("source") == "judge_direct", d).when(F.col("source") == "fallback", F.coalesce(F.nullif(r, F.lit("")), d)).otherwise(r)
    return rows.withColumn("source", source).withColumn("final", final)


def choose_variant(rows: DataFrame) -> DataFrame:
    """The path answer (A) or the plain one (B) by the judge; an unparsable verdict takes the path answer."""
    return rows.withColumn("answer", F.when(F.col("choice") == "B", F.col("plain")).otherwise(F.col("path")))


def budget_label(parts: Column) -> Column:
    """0 without image parts, 5 for images alone, 2 for both."""
    image, other = F.exists(parts, lambda x: x == "image"), F.exists(parts, lambda x: x != "image")
    return F.when(~image, 0).when(other, 2).otherwise(5)


def gather_images(docs: DataFrame, most: int) -> DataFrame:
    """A sample's distinct image paths in document order, at most ``most``."""
    x = docs.select("sample", "rank", F.posexplode("images").alias("pos", "path"))
    first = x.groupBy("sample", "path").agg(F.min(F.struct("rank", "pos")).alias("o"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("sample").orderBy("o.rank", "o.pos"))).where(F.col("position") <= most).select("sample", "path", "position")
