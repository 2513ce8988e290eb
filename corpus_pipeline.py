"""Corpus pipeline: five stages from raw documents to packed training sequences.

In every stage: an empty table gives an empty one; rows count one by one, whether their ids repeat or
are null; columns that operators use as results come back as they were; texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlink.llm._blocks import BLOCK_BYTES
from tierlink.llm._columns import set_aside
from tierlink.llm.decontaminate import find_leaks
from tierlink.llm.near_dedup import RESULT as DEDUP_COLUMNS
from tierlink.llm.near_dedup import near_dedup
from tierlink.llm.packing import pack
from tierlink.llm.quality_rules import RESULT as QUALITY_COLUMNS
from tierlink.llm.quality_rules import quality_rules
from tierlink.llm.suffix_dedup import RESULT as SUFFIX_COLUMNS
from tierlink.llm.suffix_dedup import suffix_dedup
from tierlink.session import materialize, ship


#: Smaller blocks than the operator's own, as executors hold what earlier stages left in their heap.
SUFFIX_BLOCK = BLOCK_BYTES // 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; a null or empty text has too few words. Equal texts fare alike."""
    return set_aside(docs, QUALITY_COLUMNS, lambda x: quality_rules(x).where("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: each row counts as a document, whether its id is repeated or null; the least id stays."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))  # written, so numbers stay
    found = near_dedup(rows, "__row").select("component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "__row").alias("first"))
    chosen = found.groupBy("component_id").agg(F.min("first").alias("first")).select("first.__row")
    return rows.join(chosen, "__row", "left_semi").drop("__row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8 or more), that of the least id.

    Of rows of one id (or of null ids, which come last) the first in the table stays. Texts without words, null ones among them, are in no group.
    """
    return set_aside(docs, DEDUP_COLUMNS, one_of_each)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur elsewhere; a character cut in part goes whole.

    Every place of such a string goes, the first too. A null text stays null, one that loses all is empty; no row goes.
    """
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col("kept").cast("string"))
    return set_aside(docs, SUFFIX_COLUMNS, lambda x: suffix_dedup(x, block_bytes=SUFFIX_BLOCK, characters=True).withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none, null and empty items are leaked by none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return set_aside(docs, {"leaks"}, lambda x: find_leaks(x, benchmark, free_ends=True).where(F.size("leaks") == 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture-controlled training sequences; a null or empty text is one end token, a null source a queue of its own."""
    return pack(docs).drop("ids")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", decontaminated),
    ("packing", packed),
]

# Suffix matching, edit distances and tokenising are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
