"""Graph index of vectors: built by exchanging neighbours, searched by rounds of a beam, both as joins.

A row's edges go to the nearest rows found so far. A round of building looks at the neighbours of its
neighbours, forwards and backwards, and keeps the nearest; a row that many others point to offers
as many of them as it has edges itself, so no join grows with its popularity. A search starts at the nearest of a bounded sample of
rows and, round by round, reads the neighbours of what is new among each query's ``beam`` best. Every round is a table of at
most ``beam`` rows a query, and only vectors that are met are read: the share is part of the report.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tierlink.functions.numeric import squared_l2
from tierlink.operators import vectors as VX
from tierlink.operators.closest import matrix
from tierlink.operators.neighbours import best_of, knn_join, vector_column
from tierlink.session import broadcast_if_small, materialize

ENTRIES = 64  # sampled rows that searches start from


def nearest_of(edges: DataFrame, by: str, other: str, most: int) -> DataFrame:
    """The ``most`` edges of least d of each ``by``; Spark cuts them before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.round("d", 9), other)
    return edges.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def build_graph(index: DataFrame, degree: int = 24, rounds: int = 3, per_cell: int = 256) -> DataFrame:
    """V2: (a, b, d): edges of each row of ``index`` (name, v) to about its ``degree`` nearest, and back; d is the squared distance.

    The first edges come from each row's own cell; building ends early when a round changes nothing.
    """
    index = materialize(index.where("v is not null").select("name", vector_column(index)))
    first = knn_join(index.withColumnRenamed("name", "q"), index, degree + 1, recall=0.3, per_cell=per_cell)
    graph = materialize(nearest_of(first.select(F.col("q").alias("a"), F.col("name").alias("b"), F.col("score").alias("d")).where("a <> b"), "a", "b", degree))
    for _ in range(rounds):
        back = nearest_of(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"), "a", "b", degree)
        both = materialize(graph.unionByName(back).dropDuplicates(["a", "b"]))
        new = introduced(both, graph, index, degree).join(graph.select("a", "b"), ["a", "b"], "left_anti").withColumn("new", F.lit(1))
        kept = materialize(nearest_of(graph.withColumn("new", F.lit(0)).unionByName(new), "a", "b", degree))
        changed = kept.agg(F.sum("new").alias("n")).first()["n"] or 0
        graph = kept.drop("new")
        if not changed:
            break
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    return materialize(graph.unionByName(nearest_of(back, "a", "b", degree)).dropDuplicates(["a", "b"]))


def introduced(both: DataFrame, graph: DataFrame, index: DataFrame, degree: int) -> DataFrame:
    """Distinct (a, b, d): neighbours b of a's neighbours over the edges ``both`` that are as near as a's last edge of ``graph``, or all if it has under ``degree``.

    A row's neighbours meet where its own edges are: each vector is sent once an edge, not once a pair, and pairs
    that can't become edges are dropped there.
    """
    bars = graph.groupBy("a").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(float("inf")).alias("bar"))
    ends = both.select(F.col("a").alias("via"), F.col("b").alias("name"), F.lit(0).alias("side"), F.lit(0).alias("into")).unionByName(both.select(F.col("b").alias("via"), F.col("a").alias("name"), F.lit(1).alias("side"), F.lit(1).alias("into")))
    ends = ends.groupBy("via", "name").agg(F.min("side").alias("side"), F.max("into").alias("into"))  # side 0: offered, into 1: looks at what is offered
    known = index.join(bars.withColumnRenamed("a", "name"), "name", "left").withColumn("bar", F.coalesce("bar", F.lit(float("inf"))))
    met = ends.join(known, "name").select("via", "side", "into", "name", "bar", "v").repartition("via").sortWithinPartitions("via", "side")
    kind = dict(index.dtypes)["name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        via, names, held = None, None, None
        waiting: list[pa.RecordBatch] = []

        def pairs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            part = part.filter(pc.equal(part.column("into"), 1))
            for lo in range(0, part.num_rows, 256):
                own = part.slice(lo, 256)
                d = ((matrix(own.column("v"), held.shape[1])[:, None] - held[None]) ** 2).sum(2)
                near = np.round(d, 9) <= np.round(own.column("bar").to_numpy(), 9)[:, None]
                i, j = (pa.array(x) for x in np.nonzero(near))
                a, b = own.column("name").take(i), names.take(j)
                other = pc.not_equal(a, b)
                yield pa.RecordBatch.from_arrays([a.filter(other), b.filter(other), pa.array(d[near]).filter(other)], names=["a", "b", "d"])

        def offered() -> Iterator[pa.RecordBatch]:
            """What waits is all that is offered by a row, at most twice ``degree``."""
            nonlocal names, held
            if waiting:
                own = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                names, held = own.column("name"), matrix(own.column("v"))
                waiting.clear()
                yield from pairs(own)

        for (at, side), part in runs_of(batches):
            if at != via:
                yield from offered()
                via, names, held = at, None, None
            if side == 0:
                waiting.append(part)
            else:
                yield from offered()
                if held is not None:
                    yield from pairs(part)
        yield from offered()

    return met.mapInArrow(run, f"a {kind}, b {kind}, d double").dropDuplicates(["a", "b"])


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((via, side), rows) of ordered batches, cut at batches; via may be of any type."""
    for batch in batches:
        if batch.num_rows:
            via, side = batch.column("via").to_numpy(zero_copy_only=False), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((via[1:] != via[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                yield (via[lo], side[lo]), batch.slice(lo, hi - lo)


def entered(queries: DataFrame, index: DataFrame, starts: int, entries: int = ENTRIES) -> DataFrame:
    """(q, name, score): the ``starts`` nearest to each query among the ``entries`` rows of least hashes, which go to the tasks."""
    sample = index.orderBy(F.xxhash64("name"), "name").limit(entries).select("name", "v").collect()
    kind = to_arrow_type(index.schema["name"].dataType)
    names, vectors = np.array([r["name"] for r in sample]), np.array([r["v"] for r in sample], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(names):
                d = VX.squared_distances(matrix(batch.column(1), vectors.shape[1]), vectors)
                picked = [(i, at) for i, at in best_of(-d, names, starts)]
                rows, at = np.concatenate([np.full(len(a), i) for i, a in picked]), np.concatenate([a for _, a in picked])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names[at]).cast(kind), pa.array(d[rows, at])], names=["q", "name", "score"])

    return queries.select("q", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"q {dict(queries.dtypes)['q']}, name {dict(index.dtypes)['name']}, score double")


def search_graph(queries: DataFrame, index: DataFrame, graph: DataFrame, k: int, beam: int = 64, starts: int = 4, rounds: int = 64) -> tuple[DataFrame, int]:
    """V2: ((q, name, score, rank), number of distances worked out): the ``k`` nearest that the beam of each query (q, v) meets.

    ``beam`` is at least 8 ``k``. A search is over when nothing new is among its best; ``rounds`` bounds their number.
    """
    beam = max(beam, 8 * k)
    queries = materialize(queries.where("v is not null").select("q", "v"))
    asked = broadcast_if_small(queries)
    index = index.where("v is not null").select("name", "v")
    state = materialize(entered(queries, index, starts).withColumn("fresh", F.lit(True)))
    read = queries.count() * min(ENTRIES, index.count())
    met_before = [state.select("q", "name")]  # every pair is worked out once
    for _ in range(rounds):
        seen = state.where("fresh").join(graph.select(F.col("a").alias("name"), "b"), "name").select("q", F.col("b").alias("name")).distinct()
        new = seen.join(reduce(DataFrame.unionByName, met_before), ["q", "name"], "left_anti")
        new = new.join(index.select("name", F.col("v").alias("y")), "name").join(asked.select("q", F.col("v").alias("x")), "q")
        new = materialize(new.select("q", "name", squared_l2(F.col("x"), F.col("y")).alias("score"), F.lit(True).alias("fresh")))
        met_before.append(new.select("q", "name"))
        met = new.count()
        read += met
        if not met:
            break
        order = Window.partitionBy("q").orderBy(F.round("score", 9), "name")
        both = state.withColumn("fresh", F.lit(False)).unionByName(new)
        state = materialize(both.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= beam).drop("__r"))
    order = Window.partitionBy("q").orderBy(F.round("score", 9), "name")
    return state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "name", "score", "rank"), read
