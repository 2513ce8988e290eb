"""Preparation of raw question-answering data: corpora, multimodal documents, test rows, properties and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.operators.build import answers_of, keyed_row, linearize_table, media_path
from tierlink.sources.sinks import exists


def titled(title: Column, key: Column, text: Column) -> Column:
    """The title (the id without one), a line break and the text, trimmed at the ends."""
    return F.regexp_replace(F.concat(F.coalesce(title, key.cast("string")), F.lit("\n"), F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")


def text_and_table_corpus(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, text) of texts (doc_id, title, text) and of tables (doc_id, title, name, headers, rows) in lines; a table wins over a text of its id."""
    t = texts.select("doc_id", titled(F.col("title"), F.col("doc_id"), F.col("text")).alias("text"))
    b = tables.select("doc_id", titled(F.col("title"), F.col("doc_id"), linearize_table(F.col("name"), F.col("headers"), F.col("rows"))).alias("text"))
    return b.unionByName(t.join(b.select("doc_id"), "doc_id", "left_anti"))


def multimodal_docs(texts: DataFrame, images: DataFrame, tables: DataFrame, image_root: str) -> DataFrame:
    """One row a document: doc_id, title, text, images and tables of all three corpora.

    ``images``: (doc_id, title, image_id, path), ``tables``: (doc_id, title, table_id, headers, rows). The title
    is the text's, else the image's, else the table's, else the id.
    """
    image = F.struct(F.coalesce("image_id", "doc_id").alias("image_id"), media_path(F.col("path"), image_root).alias("path_or_url"), F.coalesce("title", "doc_id").alias("caption"))
    i = images.groupBy("doc_id").agg(F.min("title").alias("__it"), F.sort_array(F.collect_list(image)).alias("images"))
    cells = F.transform("rows", lambda r: F.map_from_entries(keyed_row(F.col("headers"), r)))
    table = F.struct(F.coalesce("table_id", "doc_id").alias("table_id"), F.col("headers").alias("schema"), F.to_json(cells).alias("rows"))
    b = tables.groupBy("doc_id").agg(F.min("title").alias("__bt"), F.sort_array(F.collect_list(table)).alias("tables"))
    both = texts.select("doc_id", "title", "text").join(i, "doc_id", "full_outer").join(b, "doc_id", "full_outer")
    empty = {"images": F.array().cast(both.schema["images"].dataType), "tables": F.array().cast(both.schema["tables"].dataType)}
    title = F.coalesce("title", "__it", "__bt", "doc_id")
    return both.select("doc_id", title.alias("title"), F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(F.col(c), e).alias(c) for c, e in empty.items()])


def context_test(rows: DataFrame) -> DataFrame:
    """(id, question, answer, answer_aliases, supporting_facts) of rows (id, question, answer, answers, context array of ids)."""
    a = answers_of(F.col("answer"), F.col("answers"))
    facts = F.array_distinct(F.filter("context", lambda x: F.coalesce(x, F.lit("")) != ""))
    return rows.select("id", "question", a["answer"].alias("answer"), a["aliases"].alias("answer_aliases"), facts.alias("supporting_facts"))


FACT_LISTS = ("text_pos", "text_neg", "image_pos", "image_neg")


def first_facts(items: DataFrame, lists: tuple[str, str], key: str, fields: list[str]) -> DataFrame:
    """The stated fields of each fact with a key, the first of equal keys in the order of items (seq), lists and positions."""
    parts = []
    for n, name in enumerate(lists):
        parts.append(items.select("seq", F.lit(n).alias("list"), F.posexplode(name).alias("pos", "fact")).select("seq", "list", "pos", "fact.*"))
    every = parts[0].unionByName(parts[1]).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return every.groupBy(F.col(key).cast("string").alias(key)).agg(F.min_by(F.struct(*[f for f in fields if f != key]), F.struct("seq", "list", "pos")).alias("f")).select(key, "f.*")


def webqa_corpora(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snippet_id, title, fact) and (image_id, title, caption) of all facts of ``items``."""
    return first_facts(items, FACT_LISTS[:2], "snippet_id", ["snippet_id", "title", "fact"]), first_facts(items, FACT_LISTS[2:], "image_id", ["image_id", "title", "caption"])


def webqa_test(items: DataFrame) -> DataFrame:
    """(id, question, answer, supporting_facts): unquoted texts, ids of the positive facts, texts before images, each once."""
    texts = F.filter(F.transform("text_pos", lambda x: x["snippet_id"].cast("string")), lambda x: F.coalesce(x, F.lit("")) != "")
    images = F.filter(F.transform("image_pos", lambda x: x["image_id"].cast("string")), lambda x: x.isNotNull())
    answer = F.transform("answer", T.unquote)
    return items.select("id", T.unquote("question").alias("question"), answer.alias("answer"), F.array_distinct(F.concat(texts, images)).alias("supporting_facts"))


def keyed_items(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(key, fields) of a JSON object of objects; values that are no objects and blank keys are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    parsed = raw.where((F.trim("key") != "") & F.trim("v").startswith("{")).select("key", F.from_json("v", fields).alias("x"))
    return parsed.where("x is not null").select("key", "x.*")


def keyed_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of texts (captions, labels), trimmed; blank ones are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return raw.select(F.trim("key").alias("key"), F.trim("value").alias("value")).where("key <> '' and value <> ''")


# Stored tables of a dataset and their columns.
PROPERTIES = {
    "entities": "name string, id long",
    "relations": "name string, id long",
    "documents": "doc_id string, content string",
    "doc_entity": "doc_id string, entity string",
    "image_entity": "doc_id string, entity string",
    "image_docs": "doc_id string",
    "train": "id string, question string",
    "test": "id string, question string",
}


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """M8: a stored table, or one without rows if it is absent."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def properties(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """M4: the tables of a dataset, without rows where there is none."""
    return {name: table_or_empty(spark, f"{folder}/{name}", schema) for name, schema in PROPERTIES.items()}


def split_of(samples: DataFrame, name: str, split: str = "split") -> DataFrame:
    """Samples of one split."""
    return samples.where(F.col(split) == name)


def dataset_key(name: Column | str, keys: list[str]) -> Column:
    """The first of ``keys`` that the folded name holds; an error if there is none."""
    x = T.fold(name)
    found = F.coalesce(*[F.when(F.contains(x, F.lit(k)), F.lit(k)) for k in keys])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no settings for: "), x)).cast("string"))


def first_path(spark: SparkSession, paths: list[str | None]) -> str | None:
    """The first path that is there."""
    return next((p for p in paths if p and exists(spark, p)), None)


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, path): of a document's candidates (doc_id, priority, path) the first that ``files`` (path) lists."""
    there = candidates.join(files.select("path").distinct(), "path", "left_semi")
    return there.groupBy("doc_id").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))


def question_paths(images: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(id, pos, path): the relative path below ``root`` if it is listed, else the absolute one, else none; each path once."""
    under = F.concat(F.lit(root.rstrip("/") + "/"), F.trim("relative_path"))
    known = files.select(F.col("path").alias("__p")).distinct()
    x = images.withColumn("__u", F.when(F.trim("relative_path") != "", under)).join(known, F.col("__u") == F.col("__p"), "left")
    path = F.coalesce("__p", F.when(F.trim("absolute_path") != "", F.trim("absolute_path")))
    found = x.select("id", "pos", path.alias("path")).where("path is not null")
    first = Window.partitionBy("id", "path").orderBy("pos")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
