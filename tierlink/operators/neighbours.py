"""Nearest-neighbour joins of two tables of any size: cells with halos, in blocks of bounded size, without queries on the driver.

Centres of cells are fitted on a bounded sample. Every index row lies in the cell of its nearest centre; every query
looks into that cell and a halo of further ones, as many as a sample needs for the stated recall (all of them: exact).
Queries of near cells form blocks of bounded size, and the rows of the cells that a block looks into pass through its tasks
in slices (``closest``). Index rows are sent once a block and queries once a slice, never once a cell; a ranked window joins the slices' rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from tierlink.operators import graph as G
from tierlink.operators import vectors as VX
from tierlink.operators.closest import QUERIES, best_in_tasks, matrix, number_of_parts, paired, unit
from tierlink.session import materialize

BLOCK = 2048  # rows of the index in a task at least, if there are enough
SLICE = 1024  # vectors whose distances to all centres are in memory
PER_CELL = 4096  # rows of a cell that are aimed at
MOST_CELLS = 1024


def placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (id, v) with cell, that of their nearest centre; vectors as they are."""
    schema = StructType([*rows.schema.fields]).add("cell", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                own = VX.squared_distances(matrix(part.column(1), centres.shape[1]), centres).argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(run, schema)


def looked_into(centres: np.ndarray, halo: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of vectors, which cells [vector, cell] are among their ``halo`` nearest."""
    def run(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(centres)), bool)
        for lo in range(0, len(x), SLICE):
            d = VX.squared_distances(x[lo : lo + SLICE], centres)
            out[lo : lo + SLICE] = d <= np.partition(d, halo - 1, axis=1)[:, halo - 1 : halo]
        return out

    return run


def regions(centres: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of each cell: near cells share a block of about ``most`` rows; one of more rows has ``parts`` blocks from ``first`` on."""
    first, parts = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    n, open_ = 0, [np.arange(len(centres))]
    while open_:
        own = open_.pop()
        if len(own) == 1 or counts[own].sum() <= most:
            parts[own] = max(1, -(-int(counts[own].sum()) // most))
            first[own] = n
            n += int(parts[own[0]])
        else:
            own = own[np.argsort(centres[own, centres[own].var(0).argmax()], kind="stable")]
            upto = np.cumsum(counts[own])
            half = min(max(1, int(np.searchsorted(upto, upto[-1] / 2))), len(own) - 1)
            open_ += [own[half:], own[:half]]
    return first, parts


def best_of(scores: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns) of the ``k`` largest scores of each row, by name among scores equal to nine digits."""
    rounded = np.round(scores, 9)
    k = min(k, scores.shape[1])
    floor = -np.partition(-rounded, k - 1, axis=1)[:, k - 1]
    for i in range(len(scores)):
        at = np.flatnonzero(rounded[i] >= floor[i])
        yield i, at[np.lexsort((names[at], -rounded[i, at]))][:k]


def knn_join(queries: DataFrame, index: DataFrame, k: int, metric: str = "l2", recall: float | None = 0.95, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """(q, name, score, rank) of the ``k`` nearest rows of ``index`` (name, v) to each query (q, v).

    ``recall``: share of neighbours that the halo is to hold, estimated on a sample of the index; None: all cells, exactly.
    ``l2``: squared distance, ``cosine``: normalised product. Rows without a vector are left out; names are unique.
    """
    index = materialize(index.where("v is not null").select("name", vector_column(index)))
    queries = queries.where("v is not null").select("q", vector_column(queries))
    if recall is None:
        return in_blocks(queries, index.withColumn("cell", F.lit(0)), k, metric, block=block)
    if metric == "cosine":
        index, queries = (normalised(x) for x in (index, queries))
    cells = max(1, min(MOST_CELLS, index.count() // per_cell))
    centres = VX.fit_cells(index, cells)
    if not len(centres):
        return in_blocks(queries, index.withColumn("cell", F.lit(0)), k, metric, block=block)
    return in_blocks(queries, materialize(placed(index, centres)), k, metric, centres, VX.probes_for(index, centres, k, recall), block)


def vector_column(rows: DataFrame) -> Column:
    """v as doubles, or as floats where it is stored so."""
    return F.col("v").cast("array<float>" if dict(rows.dtypes)["v"] == "array<float>" else "array<double>").alias("v")


def in_blocks(queries: DataFrame, index: DataFrame, k: int, metric: str = "l2", centres: np.ndarray | None = None, halo: int = 0, block: int = BLOCK) -> DataFrame:
    """(q, name, score, rank): the ``k`` nearest rows of ``index`` (name, v, cell) among those of each query's ``halo`` nearest cells, or all without ``centres``.

    A task holds a block of queries of near cells and lets a slice of the rows of the cells pass that any of them looks into;
    a row of the index is sent once to each block that needs it, a query once for each slice.
    """
    n_queries, n_rows = queries.count(), index.count()
    blocks, slices = number_of_parts(n_queries, n_rows, block)
    seen, dims = None, None
    if centres is None or blocks == 1 or halo >= len(centres):
        if centres is not None:
            dims = centres.shape[1]
            seen = looked_into(centres, halo) if halo < len(centres) else None
        block_of, blocks_of = F.pmod(F.xxhash64("q"), F.lit(blocks)), F.sequence(F.lit(0), F.lit(blocks - 1))
    else:
        dims, seen = centres.shape[1], looked_into(centres, halo)
        queries = materialize(placed(queries, centres))
        counts = np.zeros(len(centres), np.int64)
        for r in queries.groupBy("cell").count().collect():  # one row a cell
            counts[r["cell"]] = r["count"]
        first, parts = regions(centres, counts, QUERIES)
        blocks = int((first + parts).max())
        begin, number = (F.array(*[F.lit(int(x)) for x in a]) for a in (first, parts))
        block_of = F.get(begin, F.col("cell")) + F.pmod(F.xxhash64("q"), F.get(number, F.col("cell")))
        queries = queries.withColumn("b", block_of.cast("int"))
        block_of = F.col("b")

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    own, open_ = batch.column("b").to_numpy(), seen(matrix(batch.column("v"), dims))
                    for b in np.unique(own).tolist():
                        met[b] = met.get(b, False) | open_[own == b].any(0)
            for b, cells in met.items():
                at = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), b, np.int32))], names=["cell", "b"])

        meets = queries.select("b", "v").mapInArrow(needed, "cell int, b int").groupBy("cell").agg(F.sort_array(F.collect_set("b")).alias("blocks"))  # one row a cell
        index = index.join(F.broadcast(materialize(meets)), "cell")
        blocks_of = F.col("blocks")
    near = best_in_tasks(paired(queries, index, block_of, blocks_of, slices, blocks * slices), k, metric, seen, dims)
    order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "name")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", -F.col("score")) if metric == "l2" else ranked


def normalised(rows: DataFrame) -> DataFrame:
    """v of length 1, in doubles."""
    schema = StructType([rows.schema.fields[0]]).add("v", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def measured_recall(queries: DataFrame, index: DataFrame, found: DataFrame, k: int, metric: str = "l2", sample: int = 256) -> DataFrame:
    """One row (n, recall): share of the exact neighbours of the ``sample`` queries with the least hashes that ``found`` holds."""
    some = materialize(queries.orderBy(F.xxhash64("q"), "q").limit(sample))
    exact = G.nearest(some, index, k, metric)
    hits = VX.recall(found.join(F.broadcast(some.select("q")), "q", "left_semi"), exact)
    return some.agg(F.count("*").alias("n")).crossJoin(hits)  # one row each


def synonyms(phrases: DataFrame, threshold: float = 0.8, k: int = 100, recall: float | None = 0.95) -> DataFrame:
    """(head, equivalent, tail) of near phrases (name, v): the join of the table with itself."""
    return G.synonymy_edges(knn_join(phrases.withColumnRenamed("name", "q"), phrases, k, "cosine", recall), threshold)
