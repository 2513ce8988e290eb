"""Vector indexes: approximate search by cells, late interaction, stored indexes and vector caches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlink.functions import hooks
from tierlink.session import materialize
from tierlink.sources import sinks

SAMPLE = 4096  # vectors that cell centres are fitted on


def sampled_vectors(index: DataFrame, sample: int) -> np.ndarray:
    """The ``sample`` vectors with the least hashes of their names: bounded by the parameter."""
    rows = index.orderBy(F.xxhash64("name"), "name").limit(sample).select("v").collect()
    return np.array([r["v"] for r in rows], float)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def probes_for(index: DataFrame, centres: np.ndarray, k: int, recall: float, sample: int = SAMPLE) -> int:
    """Least number of cells that hold the stated share of the k neighbours of sampled vectors among the sample."""
    x = sampled_vectors(index, sample)
    if len(x) < 2:
        return len(centres)
    ranks = squared_distances(x, centres).argsort(1, kind="stable").argsort(1)  # of each cell for each vector
    cell = squared_distances(x, centres).argmin(1)
    most = min(k, len(x) - 1)
    needed = []
    for i in range(0, len(x), 512):
        d = squared_distances(x[i : i + 512], x)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        needed.append(np.take_along_axis(ranks[i : i + 512], cell[near], 1).ravel())
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


def fit_cells(index: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """[cell, dim] centres by Lloyd's rounds on sampled vectors."""
    x = sampled_vectors(index, sample)
    if not len(x):
        return np.zeros((0, 0))
    centres = x[np.random.default_rng(3).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = squared_distances(x, centres).argmin(1)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(0)
    return centres


def in_cells(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """V2: (name, v, cell) of every row of ``index`` (name, v), written once."""
    from tierlink.operators import neighbours as N

    return materialize(N.placed(index.where("v is not null").select("name", N.vector_column(index)), centres))


def approximate(queries: DataFrame, cells: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """V2: (q, name, score, rank): the k rows of least squared distance among those of each query's ``probes`` nearest cells.

    An inverted file: a query meets the rows of some cells only; tasks keep k rows a query. All probes give the exact result.
    """
    from tierlink.operators import neighbours as N

    return N.in_blocks(queries.where("v is not null").select("q", N.vector_column(queries)), cells, k, "l2", centres, probes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours (q, name) that were found."""
    hit = exact.select("q", "name").join(found.select("q", "name").withColumn("h", F.lit(1)), ["q", "name"], "left")
    return hit.agg(F.avg(F.coalesce("h", F.lit(0)).cast("double")).alias("recall"))


def late_interaction(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """V5: (q, name, score, norm_score, rank): sum over a query's token vectors of the best product with a phrase's.

    ``queries``: (q, token, v), the stated set; ``index``: (name, v) a token each. Blocks of queries stay in a task while a slice of
    the names passes, and a task leaves k names a query; rows without a vector don't count.
    """
    from tierlink.operators import closest as C

    asked = queries.where("v is not null").select(F.struct("q", "token").alias("q"), "v")
    rows = index.where("v is not null").select("name", "v", F.lit(0).alias("cell"))
    blocks, slices = C.number_of_parts(asked.count(), rows.count(), 4096)
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    pairs = C.paired(asked, rows, F.pmod(F.xxhash64("q.q"), F.lit(blocks)), every, slices, blocks * slices)
    scores = C.phrases_in_tasks(pairs, k, dict(queries.dtypes)["q"])
    group = Window.partitionBy("q")
    ranked = scores.withColumn("rank", F.row_number().over(group.orderBy(F.round("score", 9).desc(), "name"))).where(F.col("rank") <= k)
    return ranked.withColumn("norm_score", F.coalesce(F.try_divide(F.col("score"), F.max("score").over(group)), F.lit(0.0)))


def instructed(text: Column | str, query: bool, query_instruction: str = "", passage_instruction: str = "", eos: str = "") -> Column:
    """The text behind the instruction of its kind, with the end mark of the model."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(query_instruction if query else passage_instruction), t, F.lit(eos))


def list_fingerprint(names: DataFrame, name: str = "name") -> str:
    """V6: a name for a set of entities, whatever their order: number and sums of hashes."""
    h = F.md5(name)
    part = [F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 9, 17, 25)]
    row = names.select(name).distinct().agg(F.count("*").cast("string").alias("n"), *[p.alias(f"s{i}") for i, p in enumerate(part)]).first()
    return sinks.fingerprint({k: v for k, v in row.asDict().items()})


def cached_vectors(names: DataFrame, root: str) -> DataFrame:
    """V6: (name, v) of distinct names, from the cache of that set, which is filled once."""
    path = f"{root}/{list_fingerprint(names)}"
    sinks.write_if_absent(names.select("name").distinct().select("name", hooks.apply("embed", "name").alias("v")), path)
    return names.sparkSession.read.parquet(path)


def insert_vectors(rows: DataFrame, path: str) -> None:
    """Rows (name, v) added to a stored index."""
    rows.select("name", "v").write.mode("append").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A stored index, empty if there is none."""
    if sinks.exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], "name string, v array<double>")


def reset_vectors(spark: SparkSession, path: str) -> None:
    """An index without rows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
