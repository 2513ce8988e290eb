"""Sinks: artifacts written once, caches that are appended to, and JSON, CSV and metrics output."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(config: dict) -> str:
    """MD5 of a configuration, for the name of its folder (K1, M5)."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_if_absent(df: DataFrame, path: str, force: bool = False) -> None:
    """Written once; again only by force."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_metrics_csv(metrics: DataFrame, path: str, digits: int = 4) -> None:
    """(metric, value) appended as CSV with a header."""
    metrics.select("metric", F.round("value", digits).alias("value")).orderBy("metric").write.mode("append").csv(path, header=True)


def metric_lines(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """(line) ``metric: value`` with as many digits, by name."""
    return metrics.orderBy("metric").select(F.concat("metric", F.lit(": "), F.format_string(f"%.{digits}f", "value")).alias("line"))


def write_predictions(predictions: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Predictions and their metrics as JSON lines side by side."""
    write_json(predictions, f"{folder}/prediction")
    write_json(metrics, f"{folder}/metrics")


def judge_slice(rows: DataFrame, done: DataFrame, key: str, start: int, most: int) -> DataFrame:
    """K9: the rows at places ``start`` to ``start + most`` by key that aren't done."""
    from tierlink.sources.encode import numbered

    placed = numbered(rows.select(key).distinct().withColumn("__o", F.col(key)), key, "__o")
    wanted = placed.where((F.col("id") >= start) & (F.col("id") < start + most)).select(key)
    return rows.join(wanted, key, "left_semi").join(done.select(key).distinct(), key, "left_anti")


def content_key(*columns: str) -> F.Column:
    """K5, K6: ``doc|modality|source|md5(content)`` keys; the last column is hashed as JSON."""
    *head, body = columns
    return F.concat_ws("|", *head, F.md5(F.to_json(F.struct(body))))


def append_missing(work: DataFrame, path: str, keys: list[str], process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """K4-K9: process the rows whose keys the cache lacks, append the results, return the cache of the current keys."""
    spark = work.sparkSession
    todo = work.dropDuplicates(keys)
    if exists(spark, path):
        todo = todo.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    process(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(work.select(*keys).distinct(), keys, "left_semi")


def export_ranking(scores: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(sample_id, ranking) with the k best documents and their content, best first."""
    from tierlink.operators.rank import top_k

    best = top_k(scores, ["sample_id"], k, "score", "doc_id").join(docs.select("doc_id", "content"), "doc_id", "left")
    return best.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score", "content"))).alias("ranking"))


def failures(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows whose extraction failed, with the reason."""
    return rows.where(F.col(error).isNotNull())


def index_summary(index: DataFrame) -> DataFrame:
    """One row: vectors and their size."""
    return index.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"))


def table_matrix(headers: F.Column, rows: F.Column) -> F.Column:
    """Header and rows padded with '' to the widest one (rasterising is out of scope)."""
    every = F.concat(F.array(headers), rows)
    width = F.aggregate(every, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))
    return F.transform(every, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
