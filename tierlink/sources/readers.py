"""Sources: corpora, multimodal documents, JSON lines, triple files and lookups built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MULTIMODAL = "struct<doc_id:string,title:string,text:string,images:array<struct<image_id:string,path_or_url:string,caption:string,title:string>>,tables:array<struct<table_id:string,schema:array<string>,rows:variant>>>"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a JSON object ``doc_id -> text``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "text"))


def multimodal(spark: SparkSession, path: str) -> DataFrame:
    """S3: documents of a JSON list, or of an object keyed by id; other items are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    # items are parsed apart, so one that is no object doesn't spoil the others
    def parsed(items: DataFrame, *keys: str) -> DataFrame:
        return items.where(F.ltrim("v").startswith("{")).select("pos", *keys, F.from_json("v", MULTIMODAL).alias("d"))

    listed = parsed(raw.where(F.col("value").startswith("[")).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "v")))
    listed = listed.where("d is not null").select("pos", F.coalesce("d.doc_id", "d.title", F.concat(F.lit("doc_"), F.col("pos").cast("string"))).alias("doc_id"), "d.title", "d.text", "d.images", "d.tables")
    keyed = parsed(raw.where(F.col("value").startswith("{")).select(F.posexplode(F.from_json("value", "map<string,string>")).alias("pos", "key", "v")), "key")
    keyed = keyed.where("d is not null").select("pos", F.coalesce("d.doc_id", "key").alias("doc_id"), F.coalesce("d.title", "key").alias("title"), "d.text", "d.images", "d.tables")
    return listed.unionByName(keyed)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; malformed ones fail the read or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def stream_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a folder as a stream; malformed ones are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_titles(items: DataFrame) -> DataFrame:
    """(title in lower case, doc_id) of media metadata (doc_id, title, pos); the last of a title wins."""
    return items.where(F.trim("title") != "").groupBy(F.lower(F.trim("title")).alias("title")).agg(F.max_by("doc_id", "pos").alias("doc_id"))


def triple_file(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(seq, head, relation, tail) of lines with exactly three parts; file order in ``seq``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.split("value", delimiter, -1).alias("p"))
    return lines.where(F.size("p") == 3).select("seq", F.col("p")[0].alias("head"), F.col("p")[1].alias("relation"), F.col("p")[2].alias("tail"))


def equivalence_file(spark: SparkSession, path: str) -> DataFrame:
    """The other reader of triple files: at most three parts, trimmed."""
    p = F.split(F.col("value"), ",", 3)
    return spark.read.text(path).where(F.size(p) == 3).select(F.trim(p[0]).alias("head"), F.trim(p[1]).alias("relation"), F.trim(p[2]).alias("tail"))


def doc_entity_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, entity) of a JSON object of lists; values that aren't lists are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "v"))
    return raw.select("doc_id", F.explode(F.from_json("v", "array<string>")).alias("entity"))


def document_ids(items: DataFrame) -> DataFrame:
    """Distinct id: doc_id, else title, else ``doc_{pos}``."""
    return items.select(F.coalesce("doc_id", "title", F.concat(F.lit("doc_"), F.col("pos").cast("string"))).alias("id")).distinct()


def non_blank_ids(items: DataFrame, column: str = "id") -> DataFrame:
    """Distinct ids that aren't blank."""
    return items.where(F.trim(column) != "").select(column).distinct()


def graph_entities(triples: DataFrame) -> DataFrame:
    """Heads and tails, each once."""
    return triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def corpus_with_fallback(docs: DataFrame, synthesized: DataFrame) -> DataFrame:
    """(doc_id, content): the corpus text, or the synthesised content where that is absent or blank."""
    both = docs.select("doc_id", F.col("text").alias("__t")).join(synthesized.select("doc_id", F.col("content").alias("__c")), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.coalesce(F.trim("__t"), F.lit("")) == "", F.col("__c")).otherwise(F.col("__t")).alias("content"))


def image_ids(sources: list[DataFrame | None], column: str = "doc_id") -> DataFrame:
    """Ids of the first source that exists."""
    for source in sources:
        if source is not None:
            return source.select(column).distinct()
    raise ValueError("no source of image ids")


def title_index(docs: DataFrame) -> DataFrame:
    """(title in lower case, sorted ids)."""
    return docs.groupBy(F.lower("title").alias("title")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


def later_overrides(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of the second replacing equal keys of the first."""
    return second.unionByName(first.join(second.select(key).distinct(), key, "left_anti"))


def question_images(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, path) of image files, ``image.png`` first and then by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg}").load(root).select("path")
    named = files.select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    order = Window.partitionBy("folder").orderBy(F.col("name") != "image.png", "name")
    return named.withColumn("rank", F.row_number().over(order))


def split_router(samples: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(corpus rows, test rows) by the split column."""
    return samples.where(F.col(split) == "train"), samples.where(F.col(split) == "test")


def table_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored table, built and written first if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
