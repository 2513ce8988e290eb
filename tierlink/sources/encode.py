"""Dictionary encoding of triples in order of first appearance, and inverse edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(first: DataFrame, name: str, order: str, parts: int = 256) -> DataFrame:
    """(name, id): dense ids from 0 by ``order``, in two levels so that no task sorts all names.

    Ranges of ``order`` are found by quantiles; a range's rows are ranked apart and shifted by the
    sizes of the ranges before it.
    """
    cuts = first.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.col(order)))
    placed = first.join(F.broadcast(cuts)).withColumn("__p", part).drop("cuts")  # one row of bounded size
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    shift = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    return ranked.join(F.broadcast(shift), "__p").select(name, (F.col("__before") + F.col("__r")).cast("long").alias("id"))


def dictionaries(triples: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(name, id) of entities, heads before tails of a row, and of relations."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("head").alias("name"), (F.col(seq) * 2).alias("p")), F.struct(F.col("tail").alias("name"), (F.col(seq) * 2 + 1).alias("p")))).alias("x")).select("x.*")
    entities = numbered(ends.groupBy("name").agg(F.min("p").alias("p")), "name", "p")
    relations = numbered(triples.groupBy(F.col("relation").alias("name")).agg(F.min(seq).alias("p")), "name", "p")
    return entities, relations


def encode_edges(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, rel) ids of each triple."""
    h, t, r = (x.toDF(n, i) for x, n, i in ((entities, "head", "src"), (entities, "tail", "dst"), (relations, "relation", "rel")))
    return triples.select("head", "relation", "tail").join(h, "head").join(t, "tail").join(r, "relation").select("src", "dst", "rel")


def with_inverses(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Every edge and its reverse with the relation shifted by the number of relations."""
    n = relations.agg(F.count("*").alias("n_rel"))
    back = edges.crossJoin(F.broadcast(n)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("rel") + F.col("n_rel")).alias("rel"))
    return edges.unionByName(back)


def decode_path(hops: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Names of (src, rel, dst) ids of path hops."""
    return hops.join(entities.toDF("head", "src"), "src").join(entities.toDF("tail", "dst"), "dst").join(relations.toDF("relation", "rel"), "rel")
